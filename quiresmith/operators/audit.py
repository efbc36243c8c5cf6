"""Structural audit and sanitising of marked-up pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Finding bits and the patterns that set them.
FINDINGS = {
    "script": (1, r"(?is)<script[\s>]"),
    "style": (2, r"(?is)<style[\s>]"),
    "form": (4, r"(?is)<(?:form|input|button)[\s>]"),
    "frame": (8, r"(?is)<(?:iframe|object|embed)[\s>]"),
    "handler": (16, r"(?is)<[^>]*\son[a-z]+\s*="),
    "external": (32, r"(?is)href=\"https?://"),
    "comment": (64, r"(?s)<!--"),
}
REMOVALS = {
    "script": r"(?is)<script[\s>].*?</script>",
    "style": r"(?is)<style[\s>].*?</style>",
    "comment": r"(?s)<!--.*?-->",
}


def finding_mask(html: Column) -> Column:
    """Bits of the findings; null counts as empty."""
    text = F.coalesce(html, F.lit(""))
    return sum((F.when(text.rlike(p), bit).otherwise(0) for bit, p in FINDINGS.values()), F.lit(0))


def audit(pages: DataFrame, group: str | Column, html: str = "html") -> DataFrame:
    """Union of the findings of each group."""
    return pages.groupBy(group).agg(F.bit_or(finding_mask(F.col(html))).alias("mask"), F.count(F.lit(1)).alias("n_pages"))


def policy_status(observed: Column, forbidden: int) -> Column:
    """BACKEND for unknown bits, UNSUPPORTED for forbidden ones, else OK."""
    known = sum(bit for bit, _ in FINDINGS.values())
    return F.when(observed.bitwiseAND(F.lit(~known)) != 0, "BACKEND").when(observed.bitwiseAND(F.lit(forbidden)) != 0, "UNSUPPORTED").otherwise("OK")


def sanitize(html: Column, names: list[str]) -> Column:
    """Without the elements of the named findings; null stays null."""
    for name in names:
        html = F.regexp_replace(html, REMOVALS[name], "")
    return html


def sanitized(pages: DataFrame, names: list[str], html: str = "html") -> DataFrame:
    """Adds ``clean``, the masks ``before`` and ``after``, and ``status``: UNSUPPORTED if a selected finding remains."""
    selected = sum(FINDINGS[n][0] for n in names)
    out = pages.withColumn("clean", sanitize(F.col(html), names)).withColumn("before", finding_mask(F.col(html)))
    return out.withColumn("after", finding_mask(F.col("clean"))).withColumn("status", F.when(F.col("after").bitwiseAND(F.lit(selected)) != 0, "UNSUPPORTED").otherwise("OK"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, link_no, uri, kind`` of every href in double quotes, in order."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), 1)).alias("link_no", "uri"))
    uri = F.col("uri")
    return found.withColumn("kind", F.when(uri.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), "uri").when(uri.startswith("#"), "internal").when(uri.startswith("/"), "site").otherwise("relative"))
