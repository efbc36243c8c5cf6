"""Object tables back to PDF bytes, one row per document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = b"%PDF-1.7\n"
ESCAPED = {0x28: b"\\(", 0x29: b"\\)", 0x5C: b"\\\\", 0x0D: b"\\r"}
REGULAR = frozenset(b"!\"$&'*+,-.0123456789:;=?@ABCDEFGHIJKLMNOPQRSTUVWXYZ\\^_`abcdefghijklmnopqrstuvwxyz|~")


def _name(raw: bytes) -> bytes:
    return b"/" + b"".join(bytes([c]) if c in REGULAR else b"#%02X" % c for c in raw)


def serialize_objects(nodes: list[dict], edges: list[dict]) -> bytes:
    """A file with what node 0, the trailer, reaches: objects numbered in order of first use, in a plain table.

    The same tables always give the same bytes. Edges of arrays are written by ordinal, others by key.
    """
    by_id = {n["node"]: n for n in nodes}
    out_edges: dict[int, list[dict]] = {}
    for e in sorted(edges, key=lambda e: (e["src"], e["ordinal"] if e["key"] is None else 0, e["key"] or "")):
        out_edges.setdefault(e["src"], []).append(e)
    numbers: dict[int, int] = {}
    order: list[int] = []

    def text(i: int, top: bool = False) -> bytes:
        n = by_id[i]
        if n["indirect"] and not top:
            if i not in numbers:
                numbers[i] = len(order) + 1
                order.append(i)
            return b"%d 0 R" % numbers[i]
        kind = n["kind"]
        if kind == "null":
            return b"null"
        if kind == "boolean":
            return b"true" if n["number"] else b"false"
        if kind in ("integer", "real"):
            return n["data"]
        if kind == "name":
            return _name(n["data"])
        if kind == "string":
            return b"(" + b"".join(ESCAPED.get(c, bytes([c])) for c in n["data"]) + b")"
        members = out_edges.get(i, [])
        if kind == "array":
            return b"[" + b" ".join(text(e["dst"]) for e in members) + b"]"
        skip = {"Length"} if kind == "stream" else {"Size", "Prev", "XRefStm", "W", "Index", "Filter", "DecodeParms", "Type", "Length"} if i == 0 else set()
        body = b"".join(_name(e["key"].encode("latin-1")) + b" " + text(e["dst"]) + b" " for e in members if e["key"] not in skip)
        if kind == "stream":
            return b"<< " + body + b"/Length %d >>\nstream\n" % len(n["stream"]) + n["stream"] + b"\nendstream"
        return body if i == 0 else b"<< " + body + b">>"

    trailer = text(0, True)
    out, places, at = [HEADER], [], len(HEADER)
    for k, i in enumerate(order, 1):  # grows while it is walked
        part = b"%d 0 obj\n%s\nendobj\n" % (k, text(i, True))
        places.append(at)
        at += len(part)
        out.append(part)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(order) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return b"".join(out) + table + b"trailer\n<< %s/Size %d >>\nstartxref\n%d\n%%%%EOF\n" % (trailer, len(order) + 1, at)


def serialize(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, content`` of every document with nodes. A document is gathered in one row, as its file is one value."""
    packed = nodes.groupBy("doc_id").agg(F.collect_list(F.struct("node", "kind", "indirect", "number", "data", "stream")).alias("nodes"))
    linked = edges.groupBy("doc_id").agg(F.collect_list(F.struct("src", "ordinal", "key", "dst")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [serialize_objects(n, e or []) for n, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "content"])

    return packed.join(linked, "doc_id", "left").mapInArrow(run, "doc_id string, content binary")
