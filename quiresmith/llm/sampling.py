"""Bounded, repeatable samples of labelled rows, for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def class_counts(rows: DataFrame, label: str) -> dict:
    """Rows of each non-null label."""
    return {v: n for v, n in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def bounded_sample(rows: DataFrame, label: str, key: str, per_class: int, counts: dict) -> DataFrame:
    """About ``per_class`` rows of each label, those of smallest key hash, and never more than twice that in all.

    The hash threshold comes from the label's row count, so no rows are sorted or sent together beyond the sample.
    Which rows stay depends on the rows alone: those over the bound, as of repeated keys, go in the order of all columns.
    """
    chance = F.lit(0.0)
    for value, n in counts.items():
        chance = F.when(F.col(label) == value, F.lit(min(1.0, per_class / n))).otherwise(chance)
    place = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(place < chance).orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(2 * per_class * max(1, len(counts)))


def level_of(sizes: list[int], most: int) -> int | None:
    """The largest c for which the sizes, each cut to c, are ``most`` in all; None if they are no more as they are."""
    if sum(sizes) <= most:
        return None
    left = most
    for i, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if size > share:
            return share
        left -= size
    return None


def spread_windows(text: Column, most: int) -> Column:
    """Texts of over ``most`` bytes as windows of up to 1,024 characters, evenly spread over the whole text, of that size in all; others as they are."""
    width = max(1, min(1024, most // 4))
    n = max(1, most // (4 * width))
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    taken = lambda whole: F.filter(whole, lambda x, i: F.floor((i + 1) * F.lit(n).cast("long") / F.size(whole)) > F.floor(i * F.lit(n).cast("long") / F.size(whole)))
    cut = F.transform(F.array(parts), lambda whole: F.array_join(F.when(F.size(whole) <= n, whole).otherwise(taken(whole)), ""))[0]
    return F.when(F.octet_length(text) > most, cut).otherwise(text)


def within_bytes(rows: DataFrame, text: str, most_rows: int, most_bytes: int) -> list:
    """All rows of a bounded sample, in the order of a hash of all columns, with about ``most_bytes`` of text in all.

    No row is left out for its size: if the texts are larger in all, the longest are each represented by windows from everywhere in them,
    all of one size in all. Sizes are asked for first, without the texts, so these are sent once and no more of them than that.
    Rows are tuples.
    """
    tie = [F.sha2(F.col(f"`{c}`"), 256) if c == text else F.col(f"`{c}`") for c in rows.columns]
    light = rows.select(F.xxhash64(*rows.columns).alias("o"), *[x.alias(f"o{i}") for i, x in enumerate(tie)], F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
    sizes = [r[0] for r in light.orderBy(*light.columns[:-1]).limit(most_rows).select("n").collect()]
    if not sizes:
        return []
    level = level_of(sizes, most_bytes)
    taken = rows.orderBy(F.xxhash64(*rows.columns), *tie).limit(len(sizes))
    if level is not None:
        taken = taken.select(*[spread_windows(F.col(f"`{c}`"), level).alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns])
    columns = taken.toArrow().columns  # one task puts them in order and Arrow sends them: no rows are merged or built in the driver's JVM
    return list(zip(*(c.to_pylist() for c in columns), strict=True))
