"""Operators over text lines, spans and interned values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.functions.scan import with_islands, with_ordinal
from quiresmith.functions.text import match_count, match_offsets


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line``: one row per line, from 0; null texts have none, empty texts one empty line."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def search_lines(docs: DataFrame, needle: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, offset`` of every match inside a line, overlapping ones too, in code points from 0.

    Texts without the needle are dropped before they are split.
    """
    lines = line_table(docs.where(F.contains(F.col(text), F.lit(needle))), key, text).where(F.contains("line", F.lit(needle)))
    return lines.select(key, "line_no", F.explode(match_offsets(F.col("line"), needle)).alias("offset"))


def search_counts(docs: DataFrame, needle: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_matches`` of every row; null texts have none. A needle without line feeds matches inside lines only."""
    return docs.select(key, F.coalesce(match_count(F.col(text), needle), F.lit(0)).cast("long").alias("n_matches"))


def break_islands(rows: DataFrame, key: str, order: list[str], value: str, gap: float, name: str = "line") -> DataFrame:
    """Adds the line number inside ``key``: a new line where ``value`` jumps by more than ``gap`` from the row before."""
    return with_islands(rows, key, order, lambda before: F.abs(F.col(value) - before[value]) > gap, [value], name)


def island_bounds(rows: DataFrame, key: str, value: str, line: str = "line") -> DataFrame:
    """``key, line, n, lo, hi`` of each line."""
    return rows.groupBy(key, line).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def head_spans(rows: DataFrame, key: str, order: list[str], row_id: str, value: str, gap: float) -> DataFrame:
    """``row_id, key, span``: a new span where ``value`` is further than ``gap`` from the head of its span.

    What follows depends on the head chosen before, so a key is folded in order; rows stream through, only
    the state of one key is held. Null values neither start a span nor become its head.
    """
    sorted_rows = rows.select(row_id, key, value, *[c for c in order if c not in (row_id, key, value)]).repartition(key).sortWithinPartitions(key, *order).select(row_id, key, value)
    schema = f"{row_id} {rows.schema[row_id].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, span long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head, span, begun = None, None, 0, False
        for batch in batches:
            spans = []
            for k, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or k != current:
                    current, head, span, begun = k, v, 0, True
                elif head is None:
                    head = v
                elif v is not None and abs(v - head) > gap:
                    head, span = v, span + 1
                spans.append(span)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.int64())], [row_id, key, "span"])

    return sorted_rows.mapInArrow(run, schema)


def bounds_rollup(rows: DataFrame, levels: list[str], values: list[str]) -> DataFrame:
    """Bounds of each value at every level of a hierarchy, ``level`` telling how many level columns are fixed."""
    aggs = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))]
    fixed = sum((F.lit(1) - F.grouping(c).cast("int") for c in levels), F.lit(0))
    return rows.rollup(*levels).agg(fixed.cast("int").alias("level"), *aggs)


def intern(rows: DataFrame, order: str, content: str, name: str = "pool_id") -> DataFrame:
    """``order, pool_id``: equal contents share an id; ids are dense from 1 by first occurrence; null contents have 0.

    Contents are compared by SHA-256, so that texts are not shuffled.
    """
    hashed = rows.select(order, F.sha2(F.col(content), 256).alias("_h"))
    first = hashed.where(F.col("_h").isNotNull()).groupBy("_h").agg(F.min(order).alias("_first"))
    ids = with_ordinal(first, name, "_first", "_h", start=1).select("_h", name)
    return hashed.join(ids, "_h", "left").select(order, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def ancestors_first(leaf: DataFrame, values: list[str], name: str = "value") -> DataFrame:
    """Adds the first non-null of ``values``, nearest first, and its depth (null if there is none)."""
    depth = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(i)) for i, v in enumerate(values)])
    return leaf.withColumn(name, F.coalesce(*values)).withColumn("depth", depth)


def conflicts(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """``group, n_values, status``: FORMAT where a group holds different non-null values, else OK."""
    return rows.groupBy(*group).agg(F.count_distinct(value).alias("n_values")).withColumn("status", F.when(F.col("n_values") > 1, "FORMAT").otherwise("OK"))


def path_status(commands: DataFrame, path: str, order: list[str], kind: str, point: str) -> DataFrame:
    """``path, status``: OK if a path begins with a move, draws a line and has finite points only, else FORMAT.

    Kinds are ``move``, ``line`` and ``close``, which needs no point; others and null points are FORMAT. Aggregates
    are pre-combined, so a long path needs no task of its own.
    """
    finite = F.coalesce(~F.isnan(point) & (F.abs(point) < float("inf")), F.lit(False))
    bad = ~F.coalesce(F.col(kind).isin("move", "line", "close"), F.lit(False)) | ((F.col(kind) != "close") & ~finite)
    facts = commands.groupBy(path).agg(F.min_by(kind, F.struct(*order)).alias("first"), F.max((F.col(kind) == "line").cast("int")).alias("drawn"), F.max(bad.cast("int")).alias("bad"))
    fine = (F.col("first") == "move") & (F.col("drawn") == 1) & (F.col("bad") == 0)
    return facts.select(path, F.when(fine, "OK").otherwise("FORMAT").alias("status"))
