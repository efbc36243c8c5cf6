"""Validation of compressed adjacency against a sequential check of randomly damaged models."""

import random

from quiresmith.operators.graph_model import CONTAINERS, KINDS, WITH_BYTES, first_failure

MODEL = "doc_id string, n_nodes long, n_edges long, n_bytes long, trailer long, catalog long"
NODE = "doc_id string, id long, kind string, data_offset long, data string, edge_offset long, edge_count long"
EDGE = "doc_id string, index long, target long, key_offset long, key string"


def sound(rng):
    """(model, nodes, edges) without a fault."""
    shapes = [("dictionary", None, [("/Root", 2)]), ("dictionary", None, [("/Type", 3)]), ("name", "/Catalog", [])]
    for _ in range(rng.randrange(5)):
        kind = rng.choice(["array", "dictionary", "string", "integer", "stream"])
        keys = sorted(rng.sample(["/A", "/B", "/C", "/é"], rng.randrange(4))) if kind in ("dictionary", "stream") else [""] * rng.randrange(3) if kind == "array" else []
        shapes.append((kind, "text" if kind in ("string", "stream") else None, [(k, rng.randrange(1, 4)) for k in keys]))
    nodes, edges, at = [], [], 0
    for i, (kind, data, members) in enumerate(shapes, 1):
        nodes.append([i, kind, at, data, len(edges), len(members)])
        at += len((data or "").encode())
        for key, target in members:
            edges.append([len(edges), target, at, key])
            at += len(key.encode())
    return [len(nodes), len(edges), at, 1, 2], nodes, edges


def damaged(rng, model, nodes, edges):
    for _ in range(rng.randrange(3)):
        rows = rng.choice([[model], nodes, edges or nodes])
        row = rng.choice(rows)
        place = rng.randrange(0 if rows[0] is model else 1, len(row))
        row[place] = rng.choice([None, *KINDS, "?"] if rows is nodes and place == 1 else [None, "", "x", "/A", "/Z"] if isinstance(row[place], str) or row[place] is None else [None, 0, -1, row[place] + 1, 2, 1000])
    return model, nodes, edges


def checked(model, nodes, edges):
    """The rules one after another."""
    n_nodes, n_edges, n_bytes, trailer, catalog = model
    cursor = used = 0
    size = lambda v: len((v or "").encode())
    for i, kind, at, data, first, count in nodes:
        if kind not in KINDS:
            return "VALUE", "node", i - 1
        if at != cursor or n_bytes is None or at + size(data) > n_bytes:
            return "STORAGE", "node", i - 1
        if first != used or count is None or count < 0 or n_edges is None or first + count > n_edges:
            return "STORAGE", "node", i - 1
        if (kind not in WITH_BYTES and size(data)) or (kind not in CONTAINERS and count) or (kind == "name" and not (data or "").startswith("/")):
            return "VALUE", "node", i - 1
        cursor += size(data)
        for j in range(first, first + count):
            if j >= len(edges):
                return "REFERENCE", "edge", j
            _, target, key_at, key = edges[j]
            if target is None or n_nodes is None or not 1 <= target <= n_nodes:
                return "REFERENCE", "edge", j
            if key_at != cursor:
                return "STORAGE", "edge", j
            before = edges[j - 1][3] if j > first else None
            if size(key) if kind == "array" else not (key or "").startswith("/") or (before is not None and not before.encode() < key.encode()):
                return "VALUE", "edge", j
            cursor += size(key)
        used += count
    if (len(nodes), used, cursor) != (n_nodes, n_edges, n_bytes):
        return "STORAGE", "model", 0
    for at, root in enumerate((trailer, catalog)):
        if root is None or not 1 <= root <= n_nodes:
            return "REFERENCE", "root", at
    if not nodes[trailer - 1][1] == nodes[catalog - 1][1] == "dictionary":
        return "VALUE", "root", 0
    members = lambda i: {edges[j][3]: edges[j][1] for j in range(nodes[i - 1][4], nodes[i - 1][4] + nodes[i - 1][5])}
    if members(trailer).get("/Root") != catalog:
        return "REFERENCE", "root", 0
    kind = members(catalog).get("/Type")
    return (None,) * 3 if kind and nodes[kind - 1][1] == "name" and nodes[kind - 1][3] == "/Catalog" else ("VALUE", "root", 1)


def test_equals_sequential_check(spark):
    rng = random.Random(11)
    made = {f"d{i}": damaged(rng, *sound(rng)) for i in range(600)}
    made["none"] = ([0, 0, 0, 1, 2], [], [])
    rows = [[(k, *r) for k, m in made.items() for r in ([m[0]] if part == 0 else m[part])] for part in range(3)]
    models, nodes, edges = (spark.createDataFrame(r, s).repartition(3) for r, s in zip(rows, (MODEL, NODE, EDGE), strict=True))
    got = {r.doc_id: (r.rule, r.subject, r["index"]) for r in first_failure(models, nodes, edges).collect()}
    want = {k: checked(*m) for k, m in made.items()}
    assert [(k, got[k], v, made[k]) for k, v in want.items() if got[k] != v][:3] == []
    assert len(set(want.values())) > 12
    assert first_failure(models.limit(0), nodes, edges).collect() == []
