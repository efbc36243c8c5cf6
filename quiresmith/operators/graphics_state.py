"""Graphics state of every content operator: the transform in force and how many clips are active.

No page is folded step by step. Saves and restores are matched by depth; what changes the state (a cm, the end of a path that becomes a
clip) points to the change before it in its scope, else to what the scope began with. These pointers form a forest, and pointer
doubling multiplies the transforms along them in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions.geometry import affine_product
from quiresmith.session import written

# Operators that end a path, and those that make it a clip.
PATH_ENDS = ("n", "f", "F", "f*", "S", "s", "B", "B*", "b", "b*")
CLIPS = ("W", "W*")
PAGE = ["doc_id", "page_index"]
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"


def _identity():
    return F.struct(*[F.lit(v).alias(n) for n, v in zip("abcdef", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), strict=True)])


def graphics_states(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, page_index, state_status``; ``doc_id, page_index, ord, op, depth, ctm, clips``): the state in which each operator runs.

    ``ops``: doc_id, page_index, ord (distinct in a page), op, args (array of double). A restore without a save, saves left open at the end and a
    cm without six finite numbers make the page FORMAT; such a page has no states. A new transform applies before those in force; a clip set by W or W* is active
    after the operator that ends the path, until the restore. Other operators change nothing. A page is one content stream of at most 8 MiB, so
    windows over a page are bounded. Other columns are ignored; an empty table gives empty results.
    """
    by_page = Window.partitionBy(*PAGE).orderBy("ord")
    before = by_page.rowsBetween(Window.unboundedPreceding, -1)
    rows = ops.select(*PAGE, F.col("ord").cast("long").alias("ord"), "op", F.col("args").cast("array<double>").alias("args"))
    step = F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)
    whole = F.coalesce((F.size("args") == 6) & ~F.exists("args", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    path_end = F.col("op").isin(*PATH_ENDS)
    rows = rows.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0))).withColumn("after", F.col("depth") + step)
    rows = rows.withColumn("set", F.max(F.when(F.col("op").isin(*CLIPS), F.col("ord"))).over(before)).withColumn("ended", F.max(F.when(path_end, F.col("ord"))).over(before))
    clip = path_end & F.coalesce(F.col("set") > F.coalesce("ended", F.lit(-1)), F.lit(False))
    rows = written(rows.withColumn("broken", (F.col("op") == "cm") & ~whole).withColumn("clip", clip).drop("set", "ended"), "state-ops")
    last = F.max_by("after", "ord")
    status = rows.groupBy(*PAGE).agg(F.when((F.min("after") < 0) | (last != 0) | F.max("broken"), "FORMAT").otherwise("OK").alias("state_status"))
    status = written(status, "state-status")
    rows = rows.join(status.where("state_status = 'OK'").select(*PAGE), PAGE, "left_semi")
    # every save once more as the beginning of its scope, one level down; the scope of an operator is the last one begun on its level
    shown = [*PAGE, "ord", "op", "args", "depth", "clip"]
    begun = rows.where("op = 'q'").select(*PAGE, "ord", F.lit(None).cast("string").alias("op"), F.lit(None).cast("array<double>").alias("args"), F.col("after").alias("depth"), F.lit(False).alias("clip"))
    level = Window.partitionBy(*PAGE, "depth").orderBy("ord", F.col("op").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    scoped = rows.select(shown).unionByName(begun).withColumn("scope", F.coalesce(F.max(F.when(F.col("op").isNull(), F.col("ord"))).over(level), F.lit(-1).cast("long"))).where("op IS NOT NULL")
    change = (F.col("op") == "cm") | F.col("clip")
    in_scope = Window.partitionBy(*PAGE, "scope").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # nodes: changes are 2 * ord + 1, scopes 2 * ord of their save, the page itself -2
    held = F.coalesce(F.max(F.when(change, 2 * F.col("ord") + 1)).over(in_scope), 2 * F.col("scope"))
    scoped = written(scoped.withColumn("held", held), "state-scopes")
    numbers = F.struct(*[F.get("args", F.lit(i)).alias(n) for i, n in enumerate("abcdef")])
    nodes = scoped.where(change | (F.col("op") == "q")).select(*PAGE, F.when(F.col("op") == "q", 2 * F.col("ord")).otherwise(2 * F.col("ord") + 1).alias("node"), F.col("held").alias("jump"), F.when(F.col("op") == "cm", numbers).otherwise(_identity()).cast(MATRIX).alias("m"), F.col("clip").cast("long").alias("clips"))
    nodes = written(nodes, "state-nodes")
    while not nodes.where("jump <> -2").isEmpty():
        there = nodes.select(*PAGE, F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("m").alias("outer"), F.col("clips").alias("more"))
        joined = nodes.join(there, [*PAGE, "jump"], "left")
        m = F.when(F.col("next").isNull(), F.col("m")).otherwise(affine_product(F.col("m"), F.col("outer")).cast(MATRIX))
        nodes = written(joined.select(*PAGE, "node", F.coalesce("next", F.lit(-2).cast("long")).alias("jump"), m.alias("m"), (F.col("clips") + F.coalesce("more", F.lit(0))).alias("clips")), "state-nodes")
    found = scoped.join(nodes.select(*PAGE, F.col("node").alias("held"), "m", "clips"), [*PAGE, "held"], "left")
    return status, found.select(*PAGE, "ord", "op", "depth", F.coalesce("m", _identity().cast(MATRIX)).alias("ctm"), F.coalesce("clips", F.lit(0)).alias("clips"))
