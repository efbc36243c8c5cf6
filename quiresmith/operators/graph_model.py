"""Validation of compressed adjacency: nodes that name spans of one list of edges and of one store of bytes.

Rows follow each other by equality joins on (document, place), so no document has to be in one task; the first failure in the order of the
model is a minimum over the failures of all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresmith.session import written

# Kinds of nodes, those with edges and those with bytes.
KINDS = ("null", "bool", "integer", "real", "name", "string", "array", "dictionary", "stream")
CONTAINERS = ("array", "dictionary", "stream")
WITH_BYTES = ("real", "name", "string", "stream")


def first_failure(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, rule, subject, index``: the first failure of every model, nulls where there is none.

    ``models``: doc_id, n_nodes, n_edges, n_bytes, trailer, catalog. ``nodes``: doc_id, id (from 1), kind, data_offset, data, edge_offset,
    edge_count. ``edges``: doc_id, index (from 0), target, key_offset, key (empty in arrays). Bytes are those of every node and then of the keys of its
    edges, one after another. In the order of nodes, and of a node's edges after it: VALUE for an unknown kind, STORAGE for a span of bytes or
    edges that doesn't follow the one before or leaves the store, VALUE for bytes or edges a kind hasn't, a name or key without its
    slash, or keys that don't ascend as bytes, REFERENCE for a target that isn't there; then STORAGE if spans don't fill the
    stores, and REFERENCE or VALUE for trailer (root 0) and catalog (root 1), which are dictionaries, the second the Root of the first and of
    type Catalog. Nulls fail the rule of their column. An id or index comes once.
    """
    zero = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    store = models.select("doc_id", "n_nodes", "n_edges", "n_bytes", "trailer", "catalog")
    nodes = nodes.join(store, "doc_id").withColumn("size", zero("data"))
    before = nodes.select("doc_id", (F.col("id") + 1).alias("id"), (F.col("edge_offset") + F.col("edge_count")).alias("next_edge"))
    nodes = nodes.join(before, ["doc_id", "id"], "left")
    follows = (F.col("edge_offset") == F.when(F.col("id") == 1, F.lit(0)).otherwise(F.col("next_edge"))) & (F.col("edge_count") >= 0) & (F.col("edge_offset") + F.col("edge_count") <= F.col("n_edges"))
    nodes = written(nodes.withColumn("follows", F.coalesce(follows, F.lit(False))), "model-nodes")
    # edges of the nodes before the first that doesn't follow: their spans are apart
    broken = nodes.where("NOT follows").groupBy("doc_id").agg(F.min("id").alias("stop"))
    sound = nodes.join(broken, "doc_id", "left").where("(stop IS NULL OR id < stop) AND edge_count > 0")
    owned = sound.select("doc_id", "id", "kind", "n_nodes", (F.col("data_offset") + F.col("size")).alias("start"), "edge_offset", F.explode(F.sequence(F.col("edge_offset"), F.col("edge_offset") + F.col("edge_count") - 1)).alias("index"))
    keyed = edges.select("doc_id", "index", "target", "key_offset", "key").withColumn("key_size", zero("key"))
    previous = keyed.select("doc_id", (F.col("index") + 1).alias("index"), F.col("key").alias("key_before"), (F.col("key_offset") + F.col("key_size")).alias("after_key"))
    owned = owned.join(keyed, ["doc_id", "index"], "left").join(previous, ["doc_id", "index"], "left").withColumn("j", F.col("index") - F.col("edge_offset"))
    owned = written(owned, "model-edges")
    ends = owned.groupBy("doc_id", "id").agg(F.max_by(F.col("key_offset") + F.coalesce("key_size", F.lit(0)), "j").alias("end"))
    spans = nodes.join(ends, ["doc_id", "id"], "left").select("doc_id", "id", F.coalesce("end", F.col("data_offset") + F.col("size")).alias("end"))
    last = spans.select("doc_id", (F.col("id") + 1).alias("id"), F.col("end").alias("cursor"))
    placed = nodes.join(last, ["doc_id", "id"], "left")
    start = F.when(F.col("id") == 1, F.lit(0)).otherwise(F.col("cursor"))
    kind = lambda *of: F.coalesce(F.col("kind").isin(*of), F.lit(False))
    good = lambda c: F.coalesce(c, F.lit(False))

    def failures(rows: DataFrame, phase: int, node: Column, j: Column, subject: str, index: Column, rules: list[tuple[Column, str]]) -> DataFrame:
        """Of every row its first broken rule (condition that must hold, rule)."""
        at = F.coalesce(*[F.when(~good(holds), F.struct(F.lit(i).alias("check"), F.lit(rule).alias("rule"))) for i, (holds, rule) in enumerate(rules)])
        return rows.withColumn("f", at).where("f IS NOT NULL").select("doc_id", F.struct(F.lit(phase).alias("phase"), node.cast("long").alias("node"), j.cast("long").alias("j"), F.col("f.check").alias("check")).alias("at"), F.struct(F.col("f.rule").alias("rule"), F.lit(subject).alias("subject"), index.cast("long").alias("index")).alias("failure"))

    key_first = F.col("j") == 0
    named = F.substring(F.col("data").cast("string"), 1, 1) == "/"
    of_nodes = failures(placed, 0, F.col("id"), F.lit(-1), "node", F.col("id") - 1, [
        (kind(*KINDS), "VALUE"), ((F.col("data_offset") == start) & (F.col("data_offset") + F.col("size") <= F.col("n_bytes")), "STORAGE"), (F.col("follows"), "STORAGE"),
        ((kind(*WITH_BYTES) | (F.col("size") == 0)) & (kind(*CONTAINERS) | (F.col("edge_count") == 0)), "VALUE"), (~kind("name") | named, "VALUE"),
    ])
    slash = F.substring(F.col("key").cast("string"), 1, 1) == "/"
    of_edges = failures(owned, 0, F.col("id"), F.col("j"), "edge", F.col("index"), [
        (F.col("target").between(1, F.col("n_nodes")), "REFERENCE"), (F.col("key_offset") == F.when(key_first, F.col("start")).otherwise(F.col("after_key")), "STORAGE"),
        (F.when(F.col("kind") == "array", F.col("key_size") == 0).otherwise(slash & (key_first | (F.col("key_before").cast("binary") < F.col("key").cast("binary")))), "VALUE"),
    ])
    totals = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("edge_count").alias("edges_used")).join(spans.groupBy("doc_id").agg(F.max_by("end", "id").alias("bytes_used")), "doc_id")
    whole = store.join(totals, "doc_id", "left").fillna(0, ["n", "edges_used", "bytes_used"])
    full = (F.col("n") == F.col("n_nodes")) & (F.col("edges_used") == F.col("n_edges")) & (F.col("bytes_used") == F.col("n_bytes"))
    of_model = failures(whole, 1, F.lit(0), F.lit(0), "model", F.lit(0), [(full, "STORAGE")])
    which = lambda c: store.join(nodes.select("doc_id", F.col("id").alias(c), F.col("kind").alias(f"{c}_kind")), ["doc_id", c], "left").select("doc_id", f"{c}_kind")
    member = lambda of, key, name: store.join(owned.where(F.col("key").cast("string") == key).select("doc_id", F.col("id").alias(of), F.col("target").alias(name)), ["doc_id", of]).groupBy("doc_id").agg(F.min(name).alias(name))
    kinds = member("catalog", "/Type", "type").join(nodes.select("doc_id", F.col("id").alias("type"), F.when(F.col("kind") == "name", F.col("data").cast("string")).alias("type_name")), ["doc_id", "type"])
    roots = store.join(which("trailer"), "doc_id").join(which("catalog"), "doc_id").join(member("trailer", "/Root", "root"), "doc_id", "left").join(kinds.select("doc_id", "type_name"), "doc_id", "left")
    inside = lambda c: F.col(c).between(1, F.col("n_nodes"))
    of_roots = [
        failures(roots, 2, F.lit(0), F.lit(0), "root", F.lit(0), [(inside("trailer"), "REFERENCE")]), failures(roots, 3, F.lit(0), F.lit(0), "root", F.lit(1), [(inside("catalog"), "REFERENCE")]),
        failures(roots, 4, F.lit(0), F.lit(0), "root", F.lit(0), [((F.col("trailer_kind") == "dictionary") & (F.col("catalog_kind") == "dictionary"), "VALUE"), (F.col("root") == F.col("catalog"), "REFERENCE")]),
        failures(roots, 5, F.lit(0), F.lit(0), "root", F.lit(1), [(F.col("type_name") == "/Catalog", "VALUE")]),
    ]
    found = of_nodes.unionByName(of_edges).unionByName(of_model)
    for rows in of_roots:
        found = found.unionByName(rows)
    first = found.groupBy("doc_id").agg(F.min_by("failure", "at").alias("failure"))
    return models.select("doc_id").join(first, "doc_id", "left").select("doc_id", "failure.rule", "failure.subject", "failure.index")
