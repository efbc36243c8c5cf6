"""Page-set operators: export, merge, crop, tiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresmith.functions.geometry import tile_of
from quiresmith.functions.scan import with_ordinal


def export_pages(pages: DataFrame, indices: Sequence[int], index: str = "page_index") -> DataFrame:
    """The pages of an index list, duplicates allowed, in its order as ``out_page``.

    An index without a page, or an empty list, fails the whole export: the result is empty then. The list is an
    argument of the call, hence small.
    """
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(i, int(x)) for i, x in enumerate(indices)], "out_page int, _want long")
    found = wanted.join(pages.where(F.col(index).isin([int(x) for x in indices] or [None])), F.col("_want") == F.col(index))
    missing = wanted.join(pages.select(F.col(index).cast("long").alias("_want")), "_want", "left_anti").isEmpty()
    return (found if missing and indices else found.limit(0)).drop("_want")


def export_range(pages: DataFrame, first: int, count: int, index: str = "page_index") -> DataFrame:
    """``count`` pages from ``first`` on, as ``out_page``; empty if one of them is missing."""
    found = pages.where(F.col(index).between(first, first + count - 1)).withColumn("out_page", (F.col(index) - first).cast("int"))
    return found if count > 0 and found.select(index).distinct().count() == count else found.limit(0)


def merge(inputs: Sequence[DataFrame], order: str) -> DataFrame:
    """All pages of all inputs one after another, repeats kept: ``input_no`` and ``out_page`` from 0."""
    tagged = [df.withColumn("input_no", F.lit(i)) for i, df in enumerate(inputs)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return with_ordinal(out, "out_page", "input_no", order)


def tiles(pages: DataFrame, width: Column, height: Column, cols: Column, rows: Column, keep: Sequence[str]) -> DataFrame:
    """One row per tile, row-major ``tile``; edge k of n is size * k / n."""
    base = pages.select(*keep, width.alias("_w"), height.alias("_h"), cols.alias("_c"), rows.alias("_r"))
    cut = base.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.col("_r") - 1))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    edge = lambda size, k, n: F.col(size) * k / F.col(n)
    return cut.select(
        *keep, (F.col("tile_row") * F.col("_c") + F.col("tile_col")).alias("tile"),
        edge("_w", F.col("tile_col"), "_c").alias("x0"), edge("_h", F.col("tile_row"), "_r").alias("y0"),
        edge("_w", F.col("tile_col") + 1, "_c").alias("x1"), edge("_h", F.col("tile_row") + 1, "_r").alias("y1"),
    )


def assign_to_tiles(marks: DataFrame, width: Column, height: Column, cols: Column, rows: Column, box: Column, keep: Sequence[str]) -> DataFrame:
    """``keep, tile`` for every tile that a mark's box overlaps: computed from its corners, so nothing is compared with other rows."""
    end = lambda v, size, n: F.least(F.greatest(F.ceil(v * n / size) - 1, F.lit(0).cast("long")), (n - 1).cast("long"))
    base = marks.select(*keep, cols.alias("_c"), tile_of(box["x0"], width, cols).alias("_c0"), end(box["x1"], width, cols).alias("_c1"), tile_of(box["y0"], height, rows).alias("_r0"), end(box["y1"], height, rows).alias("_r1"))
    spread = base.where("_c0 <= _c1 AND _r0 <= _r1").withColumn("_row", F.explode(F.sequence("_r0", "_r1"))).withColumn("_col", F.explode(F.sequence("_c0", "_c1")))
    return spread.select(*keep, (F.col("_row") * F.col("_c") + F.col("_col")).alias("tile"))
