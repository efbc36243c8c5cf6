"""Operators over object graphs and trees: reachability, pre-order, dangling references, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.session import written

MAX_DEPTH = 256


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node`` of everything reached from ``roots`` (column node) along ``edges`` (src, dst), roots included.

    Breadth first; each frontier is a written table, and nodes seen before do not enter the next, so cycles end.
    """
    seen = written(roots.select("node").where(F.col("node").isNotNull()).distinct(), "reached")
    frontier = seen
    while not frontier.isEmpty():
        step = edges.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).where(F.col("node").isNotNull()).distinct()
        frontier = written(step.join(seen, "node", "left_anti"), "frontier")
        seen = seen.union(frontier)
    return seen


def collect_garbage(nodes: DataFrame, key: str, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``nodes`` that are reachable."""
    live = reachable(edges, roots)
    return nodes.join(live, F.col(key) == F.col("node"), "left_semi")


def dangling(rows: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    return rows.where(F.col(ref).isNotNull()).join(targets.select(F.col(key).alias("_t")), F.col(ref) == F.col("_t"), "left_anti")


def preorder(nodes: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", ordinal: str = "ordinal") -> DataFrame:
    """``tree, node, index, parent_index, first_child, next_sibling``: pre-order numbers inside each tree, from 0.

    Children sort by ordinal, then node. Paths grow one level a round, at most MAX_DEPTH rounds; deeper trees raise
    UNSUPPORTED. Nodes that no root reaches are left out.
    """
    base = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.struct(F.col(ordinal).alias("o"), F.col(node).alias("n")).alias("_step"))
    level = base.where(F.col("parent").isNull()).select("tree", "node", "parent", F.array("_step").alias("path"))
    found, depth = level, 0
    level = written(level, "level")
    while not level.isEmpty():
        if depth == MAX_DEPTH:
            raise ValueError("UNSUPPORTED: tree too deep")
        up = level.select("tree", F.col("node").alias("parent"), F.col("path").alias("_up"))
        level = written(base.where(F.col("parent").isNotNull()).join(up, ["tree", "parent"]).select("tree", "node", "parent", F.concat("_up", F.array("_step")).alias("path")), "level")
        found, depth = found.unionByName(level), depth + 1
    by_path = Window.partitionBy("tree").orderBy("path")
    numbered = found.withColumn("index", (F.row_number().over(by_path) - 1).cast("int"))
    siblings = Window.partitionBy("tree", "parent").orderBy("index")
    numbered = numbered.withColumn("next_sibling", F.lead("index").over(siblings))
    children = numbered.where("parent IS NOT NULL").groupBy("tree", "parent").agg(F.min("index").alias("first_child"))
    up = numbered.select("tree", F.col("node").alias("parent"), F.col("index").alias("parent_index"))
    return (
        numbered.join(up, ["tree", "parent"], "left")
        .join(children.withColumnRenamed("parent", "node"), ["tree", "node"], "left")
        .select("tree", "node", "index", "parent_index", "first_child", "next_sibling")
    )


def commit(base: DataFrame, replacements: DataFrame, additions: DataFrame, key: str) -> DataFrame:
    """A new version: replaced rows give way, additions follow; the base stays as it is."""
    return base.join(replacements.select(key), key, "left_anti").unionByName(replacements).unionByName(additions)
