"""PDF files as tables of objects: one row per object and one per reference, for every document.

Python only turns bytes into objects; everything asked of them is a DataFrame operation over these tables
(quiresmith.operators.pdf). A document is read as a whole or not at all: its status is OK, or FORMAT (broken,
no repair is tried), PASSWORD (encrypted) or UNSUPPORTED (a filter that isn't lossless), and only OK ones
have objects.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.session import written

# Token classes of the format.
TOKEN = re.compile(rb"[\x00\t\n\f\r ]*(?:%[^\r\n]*[\x00\t\n\f\r ]*)*(<<|>>|\[|\]|\(|<|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|[^\x00\t\n\f\r ()<>\[\]{}/%]+|[{})>])")
REFERENCE = re.compile(rb"[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
STRING_PART = re.compile(rb"[()\\]")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MAX_NESTING = 256
# Fixed value: nodes whose facts a task holds.
PART_NODES = 400_000

NODE = "struct<node:int,kind:string,indirect:boolean,number:double,data:binary,stream:binary>"
EDGE = "struct<src:int,ordinal:int,key:string,dst:int>"
SCHEMA = f"doc_id string, status string, version string, nodes array<{NODE}>, edges array<{EDGE}>"


class Broken(Exception):
    """Carries the status of a document that can't be read."""


class Ref(int):
    """An indirect reference, by object number."""


class Name(bytes):
    """A name, without its slash."""


class Real(bytes):
    """A real number in its own spelling."""


class Stream:
    def __init__(self, head: dict, raw: bytes):
        self.head, self.raw = head, raw


def _hex_string(text: bytes) -> bytes:
    digits = re.sub(rb"[\x00\t\n\f\r ]", b"", text)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def _name(token: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token[1:]))


class Reader:
    """Objects at places of a byte string."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes:
        m = TOKEN.match(self.data, self.at)
        if not m:
            raise Broken("FORMAT")
        self.at = m.end()
        return m[1]

    def literal(self) -> bytes:
        out, depth = bytearray(), 1
        while True:
            m = STRING_PART.search(self.data, self.at)
            if not m:
                raise Broken("FORMAT")
            out += self.data[self.at : m.start()]
            self.at = m.end()
            if m[0] == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(self.data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                else:
                    c = self.data[self.at : self.at + 1]
                    self.at += 2 if self.data[self.at : self.at + 2] == b"\r\n" else 1
                    out += b"" if c in (b"\n", b"\r") else ESCAPES.get(c, c)
                continue
            depth += 1 if m[0] == b"(" else -1
            if not depth:
                return bytes(out)
            out += m[0]

    def value(self, depth: int = 0):
        """The next object; None stands for null."""
        if depth > MAX_NESTING:
            raise Broken("FORMAT")
        t = self.token()
        if t == b"<<":
            out: dict[bytes, object] = {}
            while (k := self.token()) != b">>":
                if k[:1] != b"/":
                    raise Broken("FORMAT")
                out[_name(k)] = self.value(depth + 1)
            return out
        if t == b"[":
            items: list = []
            while True:
                before = self.at
                if self.token() == b"]":
                    return items
                self.at = before
                items.append(self.value(depth + 1))
        if t == b"(":
            return self.literal()
        if t == b"<":
            end = self.data.find(b">", self.at)
            text, self.at = self.data[self.at : end], end + 1
            if end < 0 or re.search(rb"[^0-9A-Fa-f\x00\t\n\f\r ]", text):
                raise Broken("FORMAT")
            return _hex_string(text)
        if t[:1] == b"/":
            return _name(t)
        if t in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[t]
        if not NUMBER.match(t):
            raise Broken("FORMAT")
        if b"." in t:
            return Real(t)
        m = REFERENCE.match(self.data, self.at) if t.isdigit() else None
        if m:
            self.at = m.end()
            return Ref(t)
        return int(t)


def unpredict(data: bytes, params: dict) -> bytes:
    """Undo the row predictors of lossless filters."""
    kind = params.get(b"Predictor", 1)
    if kind == 1:
        return data
    if kind < 10:
        raise Broken("UNSUPPORTED")
    colors, bits, columns = params.get(b"Colors", 1), params.get(b"BitsPerComponent", 8), params.get(b"Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        row, how = bytearray(data[at + 1 : at + 1 + width]), data[at]
        for i in range(width):
            a, b, c = row[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            near = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))
            row[i] = (row[i] + (0, a, b, (a + b) // 2, near)[how if how < 5 else 0]) & 255
        out += row
        before = row
    return bytes(out)


def decoded(stream: Stream, resolve) -> bytes:
    """Decode a stream through its lossless filters."""
    listed = lambda v: v if isinstance(v, list) else [] if v is None else [v]
    filters, params = listed(resolve(stream.head.get(b"Filter"))), listed(resolve(stream.head.get(b"DecodeParms")))
    data = stream.raw
    for i, f in enumerate(map(resolve, filters)):
        settings = resolve(params[i]) if i < len(params) else None
        if f == b"FlateDecode":
            try:
                data = zlib.decompress(data)
            except zlib.error as e:
                raise Broken("FORMAT") from e
        elif f == b"ASCIIHexDecode":
            data = _hex_string(data.split(b">")[0])
        else:
            raise Broken("UNSUPPORTED")
        data = unpredict(data, {k: resolve(v) for k, v in (settings or {}).items()})
    return data


class Document:
    """The cross-reference of a file and its objects, each read once."""

    def __init__(self, data: bytes):
        head, tail = re.match(rb"[^\n]{0,1024}?%PDF-(\d\.\d)", data, re.S), data.rfind(b"startxref")
        if not head or tail < 0:
            raise Broken("FORMAT")
        self.data, self.version = data, head[1].decode("ascii")
        self.places: dict[int, tuple[int, int]] = {}
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        at, seen = Reader(data, tail + 9).value(), set()
        while isinstance(at, int) and at not in seen:
            seen.add(at)
            at = self._section(at)
        if b"Encrypt" in self.trailer:
            raise Broken("PASSWORD")
        if b"Root" not in self.trailer:
            raise Broken("FORMAT")

    def _section(self, at: int):
        """Read one cross-reference section; the place of the one before it, or None."""
        if not 0 <= at < len(self.data):
            raise Broken("FORMAT")
        r = Reader(self.data, at)
        if self.data[at : at + 4] == b"xref":
            r.at += 4
            while (t := r.token()) != b"trailer":
                first, n = int(t), int(r.token())
                for i in range(n):
                    place, _, state = int(r.token()), r.token(), r.token()
                    if state == b"n":
                        self.places.setdefault(first + i, (1, place))
            head = r.value()
            if isinstance(head.get(b"XRefStm"), int):
                self._section(head[b"XRefStm"])
        else:
            stream = self._object_at(at)
            if not isinstance(stream, Stream):
                raise Broken("FORMAT")
            head, rows = stream.head, decoded(stream, lambda v: v)
            widths = head[b"W"]
            index = head.get(b"Index", [0, head[b"Size"]])
            numbers = [a + i for a, n in zip(index[::2], index[1::2], strict=True) for i in range(n)]
            for k, number in enumerate(numbers):
                at_row, fields = k * sum(widths), []
                for w in widths:
                    fields.append(int.from_bytes(rows[at_row : at_row + w], "big") if w else 1)
                    at_row += w
                if fields[0] in (1, 2):
                    self.places.setdefault(number, (fields[0], fields[1] if fields[0] == 1 else fields[1] << 32 | fields[2]))
        for k, v in head.items():
            self.trailer.setdefault(k, v)
        return head.get(b"Prev")

    def _object_at(self, at: int):
        r = Reader(self.data, at)
        if not r.token().isdigit() or not r.token().isdigit() or r.token() != b"obj":
            raise Broken("FORMAT")
        value = r.value()
        m = re.compile(rb"[\x00\t\n\f\r ]*stream\r?\n").match(self.data, r.at)
        if isinstance(value, dict) and m:
            size = self.resolve(value.get(b"Length"))
            if not isinstance(size, int) or size < 0 or m.end() + size > len(self.data):
                raise Broken("FORMAT")
            return Stream(value, self.data[m.end() : m.end() + size])
        return value

    def get(self, number: int):
        if number not in self.objects:
            kind, place = self.places.get(number, (0, 0))
            self.objects[number] = None
            if kind == 1:
                self.objects[number] = self._object_at(place)
            elif kind == 2:
                holder = self.get(place >> 32)
                if not isinstance(holder, Stream):
                    raise Broken("FORMAT")
                data = decoded(holder, self.resolve)
                heads, first = Reader(data), self.resolve(holder.head[b"First"])
                offsets = [(heads.value(), heads.value())[1] for _ in range(self.resolve(holder.head[b"N"]))]
                self.objects[number] = Reader(data, first + offsets[place & 0xFFFFFFFF]).value()
        return self.objects[number]

    def resolve(self, v):
        seen = 0
        while isinstance(v, Ref):
            v, seen = self.get(v), seen + 1
            if seen > MAX_NESTING:
                raise Broken("FORMAT")
        return v

    def tables(self) -> tuple[list[dict], list[dict]]:
        """Nodes in order of discovery, breadth first from the trailer, and their edges; indirect objects are one node each."""
        nodes: list[dict] = []
        edges: list[dict] = []
        ids: dict[int, int] = {}
        queue: list[tuple[object, dict]] = []

        def add(v) -> int:
            ref = v if isinstance(v, Ref) else None
            if ref is not None and ref in ids:
                return ids[ref]
            v = self.resolve(v)
            node = {"node": len(nodes), "kind": "", "indirect": ref is not None, "number": None, "data": None, "stream": None}
            if v is None:
                node["kind"] = "null"
            elif isinstance(v, bool):
                node |= {"kind": "boolean", "number": float(v)}
            elif isinstance(v, int):
                node |= {"kind": "integer", "number": float(v), "data": str(int(v)).encode()}
            elif isinstance(v, Real):
                node |= {"kind": "real", "number": float(v), "data": bytes(v)}
            elif isinstance(v, bytes):
                node |= {"kind": "name" if isinstance(v, Name) else "string", "data": bytes(v)}
            else:
                node["kind"] = "array" if isinstance(v, list) else "stream" if isinstance(v, Stream) else "dictionary"
                if isinstance(v, Stream):
                    node["stream"] = v.raw
                queue.append((v, node))
            nodes.append(node)
            if ref is not None:
                ids[ref] = node["node"]
            return node["node"]

        add(self.trailer)
        for v, node in queue:  # grows while it is walked
            members = [(None, x) for x in v] if isinstance(v, list) else sorted((v.head if isinstance(v, Stream) else v).items())
            for i, (k, x) in enumerate(members):
                edges.append({"src": node["node"], "ordinal": i, "key": None if k is None else k.decode("latin-1"), "dst": add(x)})
        return nodes, edges


def parse(data: bytes | None) -> dict:
    """Status, version, nodes and edges of one file."""
    try:
        document = Document(data or b"")
        nodes, edges = document.tables()
        return {"status": "OK", "version": document.version, "nodes": nodes, "edges": edges}
    except Broken as e:
        return {"status": str(e), "version": None, "nodes": [], "edges": []}
    except (ValueError, KeyError, IndexError, TypeError, RecursionError, AttributeError):
        return {"status": "FORMAT", "version": None, "nodes": [], "edges": []}


class Corpus:
    """The tables of a set of files: ``documents`` (doc_id, status, version), ``nodes`` and ``edges`` by doc_id."""

    def __init__(self, documents: DataFrame, nodes: DataFrame, edges: DataFrame):
        self.documents, self.nodes, self.edges = documents, nodes, edges
        self._facts: DataFrame | None = None
        self._listed: DataFrame | None = None

    def facts(self) -> DataFrame:
        """``doc_id, src, ordinal, key, dst, kind, indirect, number, name``: edges with what they lead to (nulls where there is nothing).

        Joined once, when first asked for; rows of a key lie together in each file, so that a reader of some keys skips the rest. Parts have
        a bounded number of nodes, which are hashed: a sort would compare the texts of every document's id.
        """
        if self._facts is None:
            there = self.nodes.select("doc_id", F.col("node").alias("dst"), "kind", "indirect", "number", F.when(F.col("kind") == "name", F.decode("data", "ISO-8859-1")).alias("name"))
            parts = max(int(self.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.nodes.count() // PART_NODES))
            rows = self.edges.repartition(parts, "doc_id", "dst").join(there.repartition(parts, "doc_id", "dst").hint("shuffle_hash"), ["doc_id", "dst"], "left")
            self._facts = written(rows.select("doc_id", "src", "ordinal", "key", "dst", "kind", "indirect", "number", "name").sortWithinPartitions(F.xxhash64("key")), "facts")
        return self._facts

    def listed(self) -> DataFrame:
        """``doc_id, list, ordinal, kid, kind, indirect``: what the arrays hold that a Kids or Fields member leads to; made once, for all walks."""
        if self._listed is None:
            lists = self.facts().where("key IN ('Kids', 'Fields')").select("doc_id", F.col("dst").alias("src")).distinct()
            rows = self.facts().where("key IS NULL").join(lists, ["doc_id", "src"], "left_semi")
            self._listed = written(rows.select("doc_id", F.col("src").alias("list"), "ordinal", F.col("dst").alias("kid"), "kind", "indirect"), "listed")
        return self._listed

    @classmethod
    def of(cls, parsed: DataFrame) -> Corpus:
        """From one row a document with its nodes and edges as arrays."""
        of = lambda c: parsed.select("doc_id", F.explode(c).alias("x")).select("doc_id", "x.*")
        return cls(parsed.select("doc_id", "status", "version"), of("nodes"), of("edges"))


def parsed_rows(files: DataFrame, doc_id: str = "path", content: str = "content") -> DataFrame:
    """Rows of SCHEMA for rows of (id, bytes), a stream or a table. A null or empty content is FORMAT."""
    node = pa.struct([("node", pa.int32()), ("kind", pa.string()), ("indirect", pa.bool_()), ("number", pa.float64()), ("data", pa.binary()), ("stream", pa.binary())])
    edge = pa.struct([("src", pa.int32()), ("ordinal", pa.int32()), ("key", pa.string()), ("dst", pa.int32())])
    schema = pa.schema([("doc_id", pa.string()), ("status", pa.string()), ("version", pa.string()), ("nodes", pa.list_(node)), ("edges", pa.list_(edge))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([{"doc_id": key} | parse(data.as_py())], schema=schema)

    return files.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content)).mapInArrow(run, SCHEMA)


def parse_files(files: DataFrame, doc_id: str = "path", content: str = "content") -> Corpus:
    """Parse rows of (id, bytes) once, into a written table; an empty table gives empty tables."""
    return Corpus.of(written(parsed_rows(files, doc_id, content), "pdf"))


def read_pdf(spark: SparkSession, path: str) -> Corpus:
    """All PDF files below a path, each read whole by one task."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path))
