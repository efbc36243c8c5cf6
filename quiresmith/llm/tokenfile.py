"""Token-id files in canonical length-limited Huffman code (operator 6).

Global id counts give code lengths by package-merge, lengths give canonical
codes. Documents are range-partitioned by id and written in order to shard
files. A shard's ids lie in blocks of fixed size whose bit offsets are kept as
checkpoints, so every block can be decoded on its own: all blocks of a shard
are decoded in lockstep, one table lookup per block and step.

Shard file, little-endian: magic; header (block size, code length limit,
number of symbols, documents, ids, blocks, stream bytes); code lengths (u8 per
symbol); document ids (i64) and whether they are null (u8); ids per document
(i64); checkpoints (i64); bit stream, most significant bit first.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.llm.files import Input, Output
from quiresmith.llm.textvec import LOWER, byte_class, packed, slices, word_hashes
from quiresmith.session import work_path, written

MAGIC = b"QSHUFF01"
HEADER = struct.Struct("<IIqqqqq")
BLOCK_IDS = 512
SHARD_IDS = 2_000_000
LIMIT = 16
SLICE_BYTES = 4 << 20
MEMO_ENTRIES = 500_000
INDEX = "part int, seq int, file string, n_docs long, n_tokens long"


#: Lower-casing of A-Z but for I, which behaves otherwise before combining dots.
_LOWER = np.where(np.arange(256) == 0x49, 0x49, LOWER).astype(np.uint8)
_LETTER = byte_class([(0x49, 0x49), (0x61, 0x7A)])
#: ASCII punctuation but for the apostrophe.
_MARK = byte_class([(0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])


_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])


#: Words of Latin-1 letters: a tokenizer's normalizing is plain lower-casing there, and one word is one piece.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The characters by which byte-level models know bytes: printed ones themselves, others from 256 on.
_BYTE_CHAR = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _byte_chars(word: str) -> str:
    return word if word.isascii() else "".join(map(_BYTE_CHAR.__getitem__, word.encode("utf-8")))


class WordEncoder:
    """Encodes texts with a lower-casing tokenizer that drops white space and never joins across it.

    Texts are cut at ASCII white space and between ASCII letters and punctuation, where the tokenizer cuts too.
    The ids of every piece are kept in a pool, so the library encodes each new piece only, many at once, and
    texts are put together from the pool by array operations. Pieces are found by hash and compared by content.
    Plain words go straight to the library's merge model, all else through the whole tokenizer.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [_LOWER[np.frombuffer(t.content.encode("utf-8"), np.uint8)].tobytes() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = dtype
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.pieces: list[bytes] = []
        self.pool = np.zeros(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, pieces: list[bytes]) -> None:
        """Append pieces and their ids."""
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            words = [w.decode("utf-8") for w in part]
            plain = [_PLAIN(w) is not None for w in words]
            rest = iter(self.tokenizer.encode_batch([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
            ids = [[t.id for t in self.merge(_byte_chars(w.lower()))] if p else next(rest).ids for w, p in zip(words, plain, strict=True)]
            sizes = np.asarray([len(x) for x in ids], np.int64)
            n, total = len(self.pieces), self.used + int(sizes.sum())
            while len(self.pool) < total:
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while len(self.starts) < n + len(part) + 1:
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.pool[self.used : total] = [i for x in ids for i in x]
            self.starts[n + 1 : n + 1 + len(part)] = self.used + np.cumsum(sizes)
            self.used = total
            self.pieces += part

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of texts; null is empty."""
        data, offsets = packed(texts)
        data = _LOWER[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        mark, letter = _MARK[data], _LETTER[data]
        edge[1:-1] |= (mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1])
        starts = np.flatnonzero(inside & (~before | edge))
        ends = np.flatnonzero(before & (~inside | edge))
        distinct, where, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.pieces) >= MEMO_ENTRIES:
            self._forget()
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        new: list[bytes] = []
        codes = np.empty(len(distinct), np.int64)
        for i, (h, piece) in enumerate(zip(distinct.tolist(), pieces, strict=True)):
            code = self.place.get(h)
            if code is None or self.pieces[code] != piece:
                code = len(self.pieces) + len(new)
                self.place[h] = code
                new.append(piece)
            codes[i] = code
        self._learn(new)
        code = codes[which]
        sizes = self.starts[code + 1] - self.starts[code]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(upto[-1]) + np.repeat(self.starts[code] - upto[:-1], sizes)]
        bounds = upto[np.searchsorted(starts, offsets)].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if any(x in raw for x in self.special):  # a text that holds the string of a special token is left to the library
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if any(x in raw[a:b] for x in self.special):
                    out[i] = np.asarray(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype).tobytes()
        return out


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def tokenized(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(``doc_id, ids``, type of the packed ids): the narrowest unsigned type, ``end_id`` last; null texts are empty."""
    dtype = "<u2" if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, dtype) not in _ENCODERS:
            _ENCODERS[path, dtype] = WordEncoder(path, dtype)
        encoder = _ENCODERS[path, dtype]
        end = np.asarray([end_id], dtype).tobytes()
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ids + end for ids in encoder.encode(part.column(1))], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, ids binary"), dtype


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for symbols that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    leaves = used[np.argsort(counts[used], kind="stable")]
    weights = counts[leaves].astype(np.float64)
    levels: list[np.ndarray] = []
    merged = weights
    is_leaf = np.ones(len(weights), bool)
    for _ in range(limit):
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        merged, is_leaf = both[order], order < len(weights)
    take, bits = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[leaves] = bits
    return out


class Code:
    """Canonical code of given lengths: shorter codes first, equal lengths by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = max(1, int(lengths.max(initial=1)))
        symbols = np.lexsort((np.arange(len(lengths)), lengths))
        symbols = symbols[lengths[symbols] > 0]
        spans = np.int64(1) << (self.bits - lengths[symbols].astype(np.int64))
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = (first >> (self.bits - lengths[symbols].astype(np.int64))).astype(np.uint64)
        self.symbol_of = np.zeros(1 << self.bits, np.uint32)
        self.length_of = np.ones(1 << self.bits, np.int64)
        total = int(spans.sum())
        self.symbol_of[:total] = np.repeat(symbols, spans)
        self.length_of[:total] = np.repeat(lengths[symbols], spans)

    def encode(self, ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[bytes, np.ndarray]:
        """(bit stream, bit offset of every block)."""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        at = ends - sizes
        value = self.codes[ids] << (64 - (at & 31) - sizes).astype(np.uint64)
        words = (int(ends[-1]) >> 5) + 2 if len(ids) else 1
        high = np.bincount(at >> 5, (value >> np.uint64(32)).astype(np.float64), minlength=words)
        low = np.bincount((at >> 5) + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
        return (high + low[: len(high)]).astype(">u4").tobytes(), at[::block].copy()

    def decode(self, stream: bytes, checkpoints: np.ndarray, count: int, block: int) -> np.ndarray:
        """``count`` ids; all blocks advance together."""
        raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        out = np.zeros((len(checkpoints), block), np.uint32)
        at = checkpoints.copy()
        top = 32 - self.bits
        mask = (1 << self.bits) - 1
        for step in range(min(block, count)):
            live = len(at) if (len(at) - 1) * block + step < count else len(at) - 1
            if live < len(at):
                at = at[:live]
            code = (window[at >> 3] >> (top - (at & 7))) & mask
            out[:live, step] = self.symbol_of[code]
            at += self.length_of[code]
        return out.reshape(-1)[:count]


def pack_shard(code: Code, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    stream, checkpoints = code.encode(ids)
    head = HEADER.pack(BLOCK_IDS, code.bits, len(code.lengths), len(doc_ids), len(ids), len(checkpoints), len(stream))
    keys = np.asarray([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.asarray([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head, code.lengths.tobytes(), keys.tobytes(), nulls.tobytes(), np.asarray(counts, "<i8").tobytes(), checkpoints.astype("<i8").tobytes(), stream])


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, whether null, ids per document, all ids)."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    block, _, n_symbols, n_docs, n_ids, n_blocks, n_stream = HEADER.unpack_from(data, 8)
    at = 8 + HEADER.size
    parts = []
    for dtype, n in (("u1", n_symbols), ("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs), ("<i8", n_blocks)):
        parts.append(np.frombuffer(data, dtype, n, at))
        at += parts[-1].nbytes
    ids = Code(parts[0]).decode(data[at : at + n_stream], parts[4].astype(np.int64), n_ids, block) if n_ids else np.zeros(0, np.uint32)
    return parts[1], parts[2], parts[3], ids


def id_counts(ids: DataFrame, dtype: str, size: int) -> np.ndarray:
    """Occurrences of every id over all documents; at most one row per task and id is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            packed, offsets = batch.column(0).buffers()[2], batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(offsets.buffers()[1], np.int64)[offsets.offset : offsets.offset + len(offsets) + 1]
            if len(batch.column(0)):
                counts += np.bincount(np.frombuffer(packed, np.uint8)[ends[0] : ends[-1]].view(dtype), minlength=size)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for i, n in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode all texts and write shard files below ``folder`` in ascending order of ``key``.

    Returns the index, a written table: one row per file in order of ``part, seq``.
    Null texts are empty (the end id alone); null keys come first; repeated keys
    stay together, ordered among themselves by a hash of their ids; an empty table gives an empty index. Texts of any
    length are encoded whole; keys must be integers (a string that isn't one fails). Other columns are ignored.
    One range shuffle of packed ids.
    """
    spark = docs.sparkSession
    ids, dtype = tokenized(docs, path, end_id, key, text)
    ids = written(ids, "token-ids")
    size = max(vocabulary_size(path), end_id + 1)
    counts = id_counts(ids, dtype, size)
    lengths = spark.sparkContext.broadcast(code_lengths(counts, max(LIMIT, int(size - 1).bit_length())))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum() // (4 * SHARD_IDS)) + 1)
    place = ids.select("doc_id", F.xxhash64("ids").alias("place"), "ids")  # range bounds are sampled at the driver: keys and hashes, no ids
    ordered = place.repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place", "ids").select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        code = Code(lengths.value)
        seq, keys, sizes, parts, total = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, keys, sizes, parts, total
            out = Output(folder, ".qshuff")
            out.write(pack_shard(code, keys, sizes, np.frombuffer(b"".join(parts), dtype).astype(np.int64)))
            out.close()
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([out.uri]), pa.array([len(keys)]), pa.array([total])], ["part", "seq", "file", "n_docs", "n_tokens"])
            seq, keys, sizes, parts, total = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_py()
                keys.append(k)
                parts.append(raw)
                sizes.append(len(raw) // np.dtype(dtype).itemsize)
                total += sizes[-1]
                if total >= SHARD_IDS:
                    yield flush()
        if keys:
            yield flush()

    return written(ordered.mapInArrow(run, INDEX), "token-index")


def read_token_files(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, with ``with_ids``, ``ids`` (binary, unsigned 32-bit) from the files of an index.

    ``start`` counts the ids of all documents before; it needs the whole index.
    """
    spark = index.sparkSession
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    at, bases = 0, []
    for part, n in totals:
        bases.append((part, at))
        at += n
    earlier = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = index.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select("file", (F.col("base") + F.coalesce(earlier, F.lit(0))).alias("start"))
    extra = ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = Input(file)
                keys, nulls, sizes, ids = unpack_shard(source.read(0, source.file.size()))
                source.close()
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                pieces = [raw[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64(), mask=nulls.astype(bool)), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([p.tobytes() for p in pieces], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(run, f"doc_id long, start long, n_tokens long, ids_crc32 long{extra}")


def token_file_round_trip(docs: DataFrame, path: str, end_id: int, with_ids: bool = True, **options) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, path, end_id, work_path(docs.sparkSession, "tokens"), **options), with_ids)
