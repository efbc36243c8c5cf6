"""Text search, layout and character checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of the Windows Latin code page outside Latin-1.
WINDOWS_LATIN_EXTRA = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _match_parts(text: Column, needle: str) -> Column:
    """The text cut before every match, so that each part but the first begins one; the first does if the text begins with it.

    A match may reach over several parts, as matches overlap.
    """
    if not needle:
        raise ValueError("ARGUMENT: empty needle")
    return F.split(text, "(?=" + re.sub(r"([^\w\s])", r"\\\1", needle) + ")", -1)


def match_offsets(text: Column, needle: str) -> Column:
    """Code point offsets, from 0, of all matches of ``needle``, overlapping ones too; exact and case-sensitive.

    An empty needle is an error. Null text gives null.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
    starts = F.aggregate(_match_parts(text, needle), start, step, lambda s: s["starts"])
    return F.when(text.startswith(needle), starts).otherwise(F.slice(starts, 2, F.size(starts)))


def match_count(text: Column, needle: str) -> Column:
    """Number of matches, overlapping ones too."""
    return F.size(_match_parts(text, needle)) - F.when(text.startswith(needle), 0).otherwise(1)


def windows_latin(text: Column) -> Column:
    """Characters that the Windows Latin code page lacks: their number; null text gives null."""
    return F.length(F.regexp_replace(text, f"[\\x00-\\x7F\\u00A0-\\u00FF{WINDOWS_LATIN_EXTRA}]", "")).cast("long")


def wrap(text: str, columns: int) -> list[str]:
    """Greedy lines of at most ``columns`` characters, all of one width.

    CR is dropped, TAB is a space, LF breaks; a line that is too long breaks at its last space, or else before
    the character that does not fit; spaces at line ends go. Empty text is one line; a lone CR is none.
    """
    if text and not text.replace("\r", ""):
        return []
    out = []
    for line in text.replace("\r", "").replace("\t", " ").split("\n"):
        at = 0
        while len(line) - at > columns:
            space = line.rfind(" ", at, at + columns + 1)
            cut = space if space > at else at + columns
            out.append(line[at:cut].rstrip(" "))
            at = cut + 1 if space > at else cut
        out.append(line[at:].rstrip(" "))
    return out


def measure(docs: DataFrame, key: str, text: str, columns: int) -> DataFrame:
    """``key, n_lines, width`` of wrapped texts; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [wrap(t or "", columns) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in lines], pa.int64()), pa.array([max(map(len, x), default=0) for x in lines], pa.int64())], [key, "n_lines", "width"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_lines long, width long")
