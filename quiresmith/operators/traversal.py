"""Walks over trees of objects with a budget: one level of all documents a round, never more rows than a document may ask for.

A malformed document can list a node many times on many levels, so that the number of paths grows with a power of its depth. Here a
node that comes twice on a level, or below itself, is a visit but isn't entered again; visits are counted for each document, and one
that has used up its budget leaves the walk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.operators.graph import MAX_DEPTH
from quiresmith.session import written
from quiresmith.sources.pdf import Corpus

# The least budget and visits for each byte.
LEAST_BUDGET, VISITS_PER_BYTE = 4096, 64


@dataclass(frozen=True)
class Walk:
    """``visits``: doc_id, node, path, again, bad, state and what ``enter`` adds; ``rest``: doc_id, node, path below the deepest level; ``budget``: doc_id, budget."""

    visits: DataFrame
    rest: DataFrame
    budget: DataFrame


def budgets(corpus: Corpus) -> DataFrame:
    """``doc_id, budget`` of every readable document: 64 visits for each byte of its file, at least 4096. Without sizes (``bytes``) a node counts as a byte."""
    docs = corpus.documents.where("status = 'OK'")
    if "bytes" in docs.columns:
        sized = docs.select("doc_id", F.col("bytes").alias("n"))
    else:
        sized = docs.select("doc_id").join(corpus.nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left")
    return sized.select("doc_id", F.greatest(F.lit(LEAST_BUDGET), VISITS_PER_BYTE * F.coalesce("n", F.lit(0))).cast("long").alias("budget"))


def walk(start: DataFrame, kids: DataFrame, enter: Callable[[DataFrame], DataFrame], budget: DataFrame, name: str, most_depth: int = MAX_DEPTH) -> Walk:
    """Visit ``start`` (doc_id, node, ordinal, up) and what is below, level by level.

    ``kids``: doc_id, list, ordinal, kid and columns that are the kid's own, which ``start`` has too. ``enter`` gets a level (doc_id, node, path, up, ...) and adds ``state``, handed on as ``up`` to the kids,
    ``list``, the node that lists the kids or null, and ``bad``; it may add other columns and must keep the rows it wants visited. Start
    nodes need ``up`` with the type of ``state``. Bad nodes, those seen before (``again``: on the level, by path, or above) and all of a document
    over its budget aren't entered. Documents without a budget aren't walked. A node that comes on two levels is entered on both, which the budget bounds.
    """
    own = [c for c in kids.columns if c not in ("doc_id", "list", "ordinal", "kid")]
    level = start.join(budget, "doc_id").select("doc_id", "node", F.array("ordinal").alias("path"), F.array().cast("array<int>").alias("above"), F.lit(0).cast("long").alias("used"), "budget", "up", *own)
    found = None
    for _ in range(most_depth):
        level = enter(level)
        first = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("path")) == 1
        level = written(level.withColumn("again", ~first | F.array_contains("above", F.col("node"))).withColumn("bad", F.coalesce("bad", F.lit(True))).drop("up"), name)
        shown = level.drop("above", "used", "budget")
        found = shown if found is None else found.unionByName(shown)
        if level.isEmpty():
            break
        spent = level.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        inner = level.where("list IS NOT NULL AND NOT bad AND NOT again").join(spent, "doc_id").withColumn("used", F.col("used") + F.col("n")).where("used <= budget")
        inner = inner.select("doc_id", "list", "path", F.concat("above", F.array("node")).alias("above"), "used", "budget", F.col("state").alias("up"))
        level = inner.join(kids, ["doc_id", "list"]).select("doc_id", F.col("kid").alias("node"), F.concat("path", F.array("ordinal")).alias("path"), "above", "used", "budget", "up", *own)
    return Walk(found, level.select("doc_id", "node", "path"), budget)


def first_visits(visits: DataFrame) -> DataFrame:
    """Of every node that isn't bad its first visit in order."""
    first = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("path")) == 1
    return visits.where("NOT again AND NOT bad").withColumn("_first", first).where("_first").drop("_first")


def walk_status(done: Walk) -> DataFrame:
    """``doc_id, n_visits, walk_status`` of every document that was walked.

    FORMAT with a bad node, one that is met twice or one below the deepest level, UNSUPPORTED over the budget, in this order.
    """
    nodes = done.visits.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad"))
    docs = nodes.groupBy("doc_id").agg(F.sum("n").alias("n_visits"), F.max("n").alias("most"), F.max("bad").alias("bad")).join(done.budget, "doc_id")
    docs = docs.join(done.rest.select("doc_id").distinct().withColumn("deep", F.lit(True)), "doc_id", "left")
    status = F.when(F.col("bad") | (F.col("most") > 1) | F.col("deep").isNotNull(), "FORMAT").when(F.col("n_visits") > F.col("budget"), "UNSUPPORTED").otherwise("OK")
    return docs.select("doc_id", "n_visits", status.alias("walk_status"))
