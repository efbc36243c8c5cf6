"""Exact n-gram Jaccard self-join by token-combination prefixes (operator 3)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quiresmith.llm.components import connected_components
from quiresmith.llm.textvec import LOWER, byte_class, mix, packed, sequence_hashes, slices, word_hashes, word_spans
from quiresmith.session import written

WORD_BYTES = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
SHINGLE = 5
#: Links need |x & y| * DEN >= |x | y| * NUM.
NUM, DEN = 4, 5
BASE_CLASSES = 16


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; first of each text and the total)."""
    data, offsets = packed(texts)
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, offsets, WORD_BYTES)
    words = word_hashes(data, starts, ends)
    counts = np.diff(firsts)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(n)), n)
    out = np.empty(len(text), np.uint64)
    at = np.concatenate([[0], np.cumsum(n)])
    full = sequence_hashes(words, width)
    inside = np.arange(len(text)) - at[text]
    long_enough = (counts >= width)[text]
    out[long_enough] = full[(firsts[:-1][text] + inside)[long_enough]]
    for size in range(1, width):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            short = sequence_hashes(words, size)
            out[at[rows]] = short[firsts[rows]]
    order = np.lexsort((out, text))
    out = out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[fresh], text[fresh]
    return out, np.searchsorted(text, np.arange(len(n) + 1))


def set_digests(tokens: np.ndarray, firsts: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A 64-bit digest of each set; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(salt)))])
    sizes = np.diff(firsts).astype(np.uint64)
    out = mix((sums[firsts[1:]] - sums[firsts[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + sizes)
    return np.where(sizes > 0, out, np.uint64(0))


class Identity:
    """Numbers of sets: a digest, or a second one where different sets were seen to share the first.

    Sets are told apart by both digests, 128 bits. ``shared`` lists the few first digests that stand for several
    sets; ``bits`` shortens the first digest, for tests.
    """

    def __init__(self, bits: int = 64, shared: tuple[int, ...] = ()):
        self.mask = np.uint64((1 << bits) - 1)
        self.shared = np.asarray(shared, np.int64)

    def both(self, tokens: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = (set_digests(tokens, firsts) & self.mask).view(np.int64)
        return first, set_digests(tokens, firsts, 0x2545F4914F6CDD1D).view(np.int64)

    def of(self, tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        first, second = self.both(tokens, firsts)
        return np.where(np.isin(first, self.shared), second, first)


def needed(n: np.ndarray) -> np.ndarray:
    """Mismatches that rule a partner out, plus one: n - ceil(n * NUM / DEN) + 1."""
    return n - -(-n * NUM // DEN) + 1


def level(n: int) -> int:
    """The finest split of frequent tokens into classes whose prefixes surely exist for sets of n; -1: none."""
    out, classes = -1, BASE_CLASSES
    while n * NUM // DEN >= classes + 1:
        out, classes = out + 1, classes * 4
    return out


def _band_starts() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 21 // 20))
    return out


#: Smallest sizes of bands of set sizes: each band ends a twentieth above its start.
BANDS = _band_starts()


def signatures(tokens: np.ndarray, firsts: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, whether of frequent tokens) of all texts; ``frequent`` marks tokens of the frequent class.

    Tokens are in one global order: rare before frequent, then by hash. Rare
    tokens are signatures themselves. Frequent ones fall into classes by hash,
    of each of which pairs are indexed; a prefix goes on until every token
    counts one, but the first of each class none, and the sum reaches the
    mismatches that rule a partner out, plus one. Two sets that agree in enough
    tokens share a signature: else each class would hide at most one common
    token of the shorter prefix.

    Signatures of frequent tokens belong to a band of sizes, that of the smaller
    set of a pair. A set gives them for its own band and for all below that may
    hold partners; the mismatches follow from the least size met there. So a
    set with an eighth of rare tokens has no such signature among sets of its size.
    """
    n = np.diff(firsts)
    need = needed(n)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((frequent, text))  # stable: by hash inside
    tokens, frequent = tokens[order], frequent[order]
    place = np.arange(len(tokens)) - firsts[:-1][text]
    single = ~frequent & (place < need[text])
    out, of = [tokens[single]], [text[single]]
    rare = np.bincount(text[~frequent], minlength=len(n))
    for i in np.flatnonzero(rare < need):
        rest = tokens[firsts[i] + rare[i] : firsts[i + 1]]
        size, smallest = int(n[i]), -(-int(n[i]) * NUM // DEN)
        for band in range(bisect_right(BANDS, smallest) - 1, bisect_right(BANDS, size)):
            lack = size - int(_least_overlap(size, max(smallest, BANDS[band]))) + 1 - int(rare[i])
            if lack > 0:
                depth = level(BANDS[band])
                made = rest[:lack] if depth < 0 else _class_pairs(rest, lack, BASE_CLASSES * 4**depth)
                out.append(mix(made ^ mix(np.full(1, band, np.uint64))))
                of.append(np.full(len(made), i))
    from_frequent = np.repeat([False, True], [len(out[0]), sum(map(len, out[1:]))])
    return np.concatenate(out), np.concatenate(of), from_frequent


def _class_pairs(tokens: np.ndarray, lack: int, classes: int) -> np.ndarray:
    """Signatures of the pairs inside classes, over the shortest prefix that counts ``lack``."""
    kind = (mix(tokens) & np.uint64(classes - 1)).astype(np.int64)
    repeated = np.ones(len(kind), bool)
    repeated[np.unique(kind, return_index=True)[1]] = False
    upto = int(np.searchsorted(np.cumsum(repeated), lack)) + 1
    by_kind = np.argsort(kind[:upto], kind="stable")
    kind, tokens = kind[by_kind], tokens[by_kind]
    out, gap = [], 1
    while gap < len(kind) and (same := kind[gap:] == kind[:-gap]).any():
        out.append(mix(tokens[:-gap][same] * np.uint64(3) ^ mix(tokens[gap:][same])))
        gap += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Tuning(NamedTuple):
    """Sizes that decide how work is dealt out, not what is found."""

    #: Buckets of at most so many nodes give all their pairs.
    small_bucket: int = 32
    #: A bucket of frequent tokens is split once for so many nodes of the whole table.
    salt_rows: int = 4_000_000
    #: Rows and tokens of a block of a region.
    block_rows: int = 2048
    block_tokens: int = 2_000_000
    #: Bits of the first digest of a set.
    digest_bits: int = 64


HIST_BINS = 128
FREQUENT = 32
FREQUENT_KEYS = 1_000_000
KEY_BITS_LIMIT = 1 << 30
BROADCAST_ROWS = 2_000_000


def overlap_bounds(tokens: np.ndarray, firsts: np.ndarray) -> list[bytes | None]:
    """Tokens of each set by hash bin, as bytes; None where a bin holds 255 or more.

    The sum of the smaller counts of two sets bounds their overlap from above.
    """
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    counts = np.bincount(text * HIST_BINS + (mix(tokens) >> np.uint64(57)).astype(np.int64), minlength=(len(firsts) - 1) * HIST_BINS).reshape(-1, HIST_BINS)
    small = counts.max(1, initial=0) < 255
    raw = np.minimum(counts, 255).astype(np.uint8)
    return [raw[i].tobytes() if ok else None for i, ok in enumerate(small)]


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, 1):
            tokens, firsts = shingle_sets(part.column(1))
            yield part, tokens, firsts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _members_of(identity: Identity):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, firsts in _text_slices(batches):
            first, second = identity.both(tokens, firsts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(firsts)), pa.array(first), pa.array(second), pa.array(overlap_bounds(tokens, firsts), pa.binary())], ["doc_id", "n", "node", "second", "hist"])

    return members


class Keys:
    """Token keys: the upper bits of a token; the highest of them choose the partition."""

    def __init__(self, total: int):
        self.parts = max(256, 1 << max(0, total // 1_000_000 - 1).bit_length())
        self.wide = total > KEY_BITS_LIMIT
        self.part_shift = np.uint64(65 - self.parts.bit_length())

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return tokens if self.wide else tokens >> np.uint64(32)

    def part(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens >> self.part_shift).astype(np.int64)

    def _first(self, part: int) -> int:
        """The smallest narrow key of a partition."""
        return part << (33 - self.parts.bit_length())

    def pack(self, part: int, keys: np.ndarray) -> bytes:
        """Sorted keys of one partition: as 16-bit differences where keys are narrow."""
        if self.wide:
            return keys.tobytes()
        steps = np.diff(keys.astype(np.int64), prepend=self._first(part))
        carry = steps // 65535
        out = np.zeros(len(keys) + int(carry.sum()), np.uint16)
        ends = np.cumsum(carry + 1)
        out[:] = 65535
        out[ends - 1] = steps % 65535
        return out.tobytes()

    def unpack(self, part: int, raw: bytes) -> np.ndarray:
        if self.wide:
            return np.frombuffer(raw, np.uint64)
        steps = np.frombuffer(raw, np.uint16).astype(np.int64)
        return (np.cumsum(steps)[steps != 65535] + self._first(part)).astype(np.uint64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(partition, from, to) of sorted partition numbers."""
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(heads, [*heads[1:], len(part)], strict=True):
        yield int(part[a]), int(a), int(b)


def frequent_keys(docs: DataFrame, keys: Keys, frequent: int = FREQUENT, most: int = FREQUENT_KEYS) -> np.ndarray:
    """The keys held by at least ``frequent`` documents; if those are over ``most``, the threshold rises until they are not.

    All tokens of all documents are counted. The class of a token decides the speed of the join, not its result.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in _text_slices(batches):
            values, first, n = np.unique(keys.of(np.sort(tokens)), return_index=True, return_counts=True)
            part = keys.part(np.sort(tokens)[first])
            rows = []
            for p, a, b in _by_part(part):
                more = np.flatnonzero(n[a:b] > 1)  # counted here: a hot token is one entry a slice
                rows.append((p, keys.pack(p, values[a:b]), more.astype(np.uint32).tobytes(), n[a:b][more].astype(np.uint32).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["p", "packed", "at", "n"])

    def count(group: pa.Table) -> pa.Table:
        part = group.column("p")[0].as_py()
        held, counts = [], []
        for packed_keys, at, n in zip(*(group.column(c) for c in ("packed", "at", "n")), strict=True):
            held.append(keys.unpack(part, packed_keys.as_py()))
            counts.append(np.ones(len(held[-1]), np.int64))
            counts[-1][np.frombuffer(at.as_py(), np.uint32)] = np.frombuffer(n.as_py(), np.uint32)
        values, counts = np.concatenate(held), np.concatenate(counts)
        order = np.argsort(values)
        values, counts = values[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        n = np.add.reduceat(counts, heads) if len(counts) else counts
        hit = n >= frequent
        return pa.table({"key": _signed(values[heads][hit]), "n": pa.array(n[hit])})

    found = written(docs.mapInArrow(emit, "p long, packed binary, at binary, n binary").groupBy("p").applyInArrow(count, "key long, n long"), "frequent")
    least = frequent
    while found.where(F.col("n") >= least).count() > most:
        least *= 2
    rows = found.where(F.col("n") >= least).select("key").toArrow().column("key")
    return np.sort(np.asarray(rows, np.int64).view(np.uint64))


class FrequentTokens:
    """Membership in a bounded sorted set of keys."""

    def __init__(self, values: np.ndarray, keys: Keys):
        self.values, self.keys = values, keys
        self.near = np.zeros(1 << 20, bool)
        self.near[self._low(values)] = True

    @staticmethod
    def _low(values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << 20) - 1)).astype(np.int64)

    def holds(self, tokens: np.ndarray) -> np.ndarray:
        values = self.keys.of(tokens)
        out = self.near[self._low(values)]
        rows = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.values, values[rows]), max(0, len(self.values) - 1))
        out[rows] = self.values[at] == values[rows] if len(rows) else False
        return out


def _bucket_rows(group: pa.Table, small_bucket: int) -> pa.Table:
    """Buckets of one partition of signatures: pairs of small ones (kind 0); stars of large ones, centre to node, centre itself included (kind 1).

    Where signatures are salted, every bucket of frequent tokens gives a star and its centre, as signature to node (kind 2).
    """
    sig, node, n = (np.concatenate([np.frombuffer(x.as_py(), t) for x in group.column(c)]) for c, t in (("sigs", np.uint64), ("nodes", np.int64), ("sizes", np.uint32)))
    salted = group.column("salt")[0].as_py() >= 0
    order = np.lexsort((node, sig))
    sig, node, n = sig[order], node[order], n[order].astype(np.int64)
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, n = sig[fresh], node[fresh], n[fresh]
    heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(heads, len(sig)))
    size, head = np.repeat(sizes, sizes), np.repeat(heads, sizes)
    large = (size > small_bucket) | salted
    pairs = []
    for gap in range(1, min(small_bucket, int(sizes.max(initial=0)))):
        at = np.arange(len(sig) - gap)
        at = at[(head[gap:] == head[:-gap]) & ~large[:-gap]]
        at = at[(n[at] * DEN >= n[at + gap] * NUM) & (n[at + gap] * DEN >= n[at] * NUM)]
        pairs.append(np.stack([node[at], node[at + gap]], 1))
    stars = np.stack([node[head[large]], node[large]], 1)
    tops = np.stack([sig[heads].view(np.int64), node[heads]], 1) if salted else np.zeros((0, 2), np.int64)
    parts = [np.unique(x, axis=0) for x in (np.concatenate([np.zeros((0, 2), np.int64), *pairs]), stars, tops)]
    kind = np.repeat(np.arange(3, dtype=np.int32), [len(x) for x in parts])
    both = np.concatenate(parts)
    return pa.table({"kind": pa.array(kind), "a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy())})


def candidates(docs: DataFrame, keys: Keys, frequent, identity: Identity, salts: int, small_bucket: int) -> DataFrame:
    """``kind, a, b``: candidate pairs of nodes (0), stars (1) and, with several salts, (signature, centre) (2).

    A signature of frequent tokens may be on any share of all sets, so its rows go to ``salts`` groups by node.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = FrequentTokens(frequent.value, keys)
        for _, tokens, firsts in _text_slices(batches):
            nodes = identity.of(tokens, firsts)
            once = np.unique(nodes, return_index=True)[1]  # equal sets of a slice count once
            chosen = np.zeros(len(nodes), bool)
            chosen[once] = True
            keep = np.repeat(chosen, np.diff(firsts))
            nodes, sizes = nodes[chosen], np.diff(firsts)[chosen]
            tokens = tokens[keep]
            sig, of, hot = signatures(tokens, np.concatenate([[0], np.cumsum(sizes)]), marks.holds(tokens))
            salt = np.where(hot & (salts > 1), nodes[of] % salts, -1)
            order = np.lexsort((sig, salt))
            sig, of, salt = sig[order], of[order], salt[order]
            rows = []
            for s, first, last in _by_part(salt):
                for p, a, b in _by_part(keys.part(sig[first:last])):
                    at = slice(first + a, first + b)
                    rows.append((s, p, sig[at].tobytes(), nodes[of[at]].tobytes(), sizes[of[at]].astype(np.uint32).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], ["salt", "p", "sigs", "nodes", "sizes"])

    def buckets(group: pa.Table) -> pa.Table:
        return _bucket_rows(group, small_bucket)

    return docs.mapInArrow(emit, "salt long, p long, sigs binary, nodes binary, sizes binary").groupBy("salt", "p").applyInArrow(buckets, "kind int, a long, b long")


def _least_overlap(na, nb):
    """The smallest overlap that links sets of these sizes."""
    return -(-(na + nb) * NUM // (NUM + DEN))


def _may_link(na: np.ndarray, nb: np.ndarray, ha: list, hb: list) -> np.ndarray:
    """Pairs not ruled out by size or by overlap bound."""
    out = (na * DEN >= nb * NUM) & (nb * DEN >= na * NUM)
    rows = np.flatnonzero(out & np.asarray([x is not None and y is not None for x, y in zip(ha, hb, strict=True)], bool))
    if len(rows):
        x, y = (np.frombuffer(b"".join(h[i] for i in rows), np.uint8).reshape(-1, HIST_BINS) for h in (ha, hb))
        out[rows] = np.minimum(x, y).sum(1, dtype=np.int64) >= _least_overlap(na[rows], nb[rows])
    return out


def _bounded_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
        ok = _may_link(na, nb, batch.column(4).to_pylist(), batch.column(5).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def _overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            ok[i] = (y[at] == x).sum() >= _least_overlap(len(x), len(y))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast behind a check of the size; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _sets(nodes: DataFrame, chosen: DataFrame, docs: DataFrame, identity: Identity) -> DataFrame:
    """``node, tokens`` of the nodes in ``chosen``, made anew from the texts of their documents."""
    ids = written(chosen.select("node").distinct().join(nodes, "node").select(F.col("rep").alias("doc_id")).distinct(), "pair-docs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, firsts in _text_slices(batches):
            blobs = [tokens[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(identity.of(tokens, firsts)), pa.array(blobs, pa.binary())], ["node", "tokens"])

    made = docs.join(_small(ids, ids.count()), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").mapInArrow(sets, "node long, tokens binary")
    return written(made.dropDuplicates(["node"]), "pair-sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, identity: Identity) -> DataFrame:
    """The pairs ``a, b`` of nodes that link, by their whole sets.

    Sizes and overlap bounds go first; the sets of the nodes left are made anew from their documents' texts.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hist").alias(f"h{x}"))
    bounded = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(_bounded_pairs, "a long, b long")
    bounded = written(bounded, "pairs")
    made = _sets(nodes, bounded.select(F.col("a").alias("node")).union(bounded.select("b")), docs, identity)
    side = lambda x: made.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}"))
    return bounded.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_overlapping, "a long, b long").distinct()


def _join_roots(group: pa.Table) -> pa.Table:
    """Links between different roots in two blocks of a region, no more than join them: apart (side 0) against all (side 1)."""
    node, root, n, side = (group.column(c).to_numpy() for c in ("node", "root", "n", "side"))
    blobs = group.column("tokens")
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    tokens = [np.frombuffer(blobs[int(k)].as_buffer(), np.uint64) for k in right]
    owner = np.repeat(np.arange(len(right)), [len(t) for t in tokens])
    tokens = np.concatenate([np.zeros(0, np.uint64), *tokens])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    out = []
    for x in left:
        mine = np.frombuffer(blobs[int(x)].as_buffer(), np.uint64)
        first, last = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, "right")
        many = last - first
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        overlap = np.bincount(owner[at], minlength=len(right))
        for y in right[(overlap >= _least_overlap(n[x], n[right])) & (root[right] != root[x])]:
            a, b = find(int(root[x])), find(int(root[y]))
            if a != b:
                top[a] = b
                out.append((node[x], node[y]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _links_left(stars: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, identity: Identity, tuning: Tuning) -> DataFrame | None:
    """Links between nodes of one region that the stars left in different components; None if there are no such nodes.

    All nodes of a star form a region, so that it holds every pair of its buckets. In each region the nodes
    apart from its largest component are compared with all nodes, in blocks of bounded size: exactly, where
    the sets are, with an index of their tokens. A block gives at most one link less than it has components.
    """
    rows = written(stars.withColumnRenamed("b", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "regions")
    sizes = rows.groupBy("a", "root").agg(F.count(F.lit(1)).alias("rows"))
    mixed = written(sizes.groupBy("a").agg(F.max_by("root", F.struct("rows", "root")).alias("most"), F.sum("rows").alias("rows"), F.max("rows").alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1"), "mixed")
    if mixed.isEmpty():
        return None
    rows = rows.join(mixed.select("a", "most"), "a").join(nodes.select("node", "n"), "node")
    rows = written(rows, "apart")
    deal = rows.groupBy("a").agg(*(F.greatest(F.ceil(F.count(F.when(c, 1)) / tuning.block_rows), F.ceil(F.sum(F.when(c, F.col("n"))) / tuning.block_tokens)).cast("int").alias(x) for x, c in (("lefts", F.col("root") != F.col("most")), ("rights", F.lit(True)))))
    placed = rows.join(deal, "a").join(_sets(nodes, rows, docs, identity), "node")
    of = lambda x: F.pmod(F.xxhash64("node"), F.col(x)).cast("int")
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    columns = ["a", "i", "j", "side", "node", "root", "n", "tokens"]
    lefts = placed.where("root <> most").withColumn("i", of("lefts")).withColumn("j", every("rights")).withColumn("side", F.lit(0)).select(columns)
    rights = placed.withColumn("j", of("rights")).withColumn("i", every("lefts")).withColumn("side", F.lit(1)).select(columns)
    return lefts.union(rights).groupBy("a", "i", "j").applyInArrow(_join_roots, "a long, b long").distinct()


def _regions(found: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """(star pairs, regions as ``a, b``) of candidates: with several salts, the centres of a signature form a star of their own."""
    stars = found.where("kind = 1").select("a", "b").distinct()
    if salts == 1:
        return stars, stars
    tops = found.where("kind = 2").select(F.col("a").alias("sig"), "b")
    least = tops.groupBy("sig").agg(F.min("b").alias("top"), F.collect_set("b").alias("all"))  # one entry a salt at most
    tops = written(least.select(F.col("top").alias("a"), F.explode("all").alias("b")).distinct(), "tops")
    wide = stars.join(tops.select(F.col("a").alias("top"), F.col("b").alias("a")), "a").select(F.col("top").alias("a"), "b")
    return stars.union(tops).distinct(), written(stars.union(wide).distinct(), "stars")


def _placed(docs: DataFrame, key: str, text: str, tuning: Tuning) -> tuple[DataFrame, DataFrame, Identity]:
    """(``doc_id, n, node, hist`` of every row; ``node, rep, root`` of every set that isn't empty; how sets are numbered).

    1. Sets are made from the texts; equal sets are one node. 2. All tokens are counted; the most frequent, a
    bounded number, form the frequent class. 3. Signatures are grouped: small buckets give all pairs, large ones
    a star. 4. Pairs pass size and overlap bounds, then exact comparison; components follow. 5. What a region
    holds outside its largest component is compared where the sets are, so that no link is lost.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    identity = Identity(tuning.digest_bits)
    made = written(docs.mapInArrow(_members_of(identity), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node long, second long, hist binary"), "members")

    def numbered(members: DataFrame) -> DataFrame:
        best = members.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n", "hist")).alias("r"), F.min("second").alias("low"), F.max("second").alias("high"))
        return written(best.select("node", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.hist").alias("hist"), "low", "high"), "nodes")

    nodes = numbered(made)
    shared = tuple(r[0] for r in nodes.where("low <> high").select("node").collect())  # pairs of 64-bit digests that meet: about none below 10^9 sets
    members = made
    if shared:
        identity = Identity(tuning.digest_bits, shared)
        members = made.withColumn("node", F.when(F.col("node").isin(*shared) & (F.col("n") > 0), F.col("second")).otherwise(F.col("node")))
        nodes = numbered(members)
    keys = Keys(int(members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    frequent = spark.sparkContext.broadcast(frequent_keys(docs, keys))
    salts = -(-nodes.count() // tuning.salt_rows) or 1
    found = written(candidates(docs, keys, frequent, identity, salts, tuning.small_bucket), "candidates")
    stars, regions = _regions(found, salts)
    pairs = found.where("kind = 0").select("a", "b").union(stars.where("a <> b").select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    links = written(verified(pairs, nodes, docs, identity), "links")
    roots = connected_components(links)
    more = _links_left(regions, roots, nodes, docs, identity, tuning)
    if more is not None:
        roots = connected_components(links.union(written(more, "links")))
    return members, nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), identity


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", tuning: Tuning = Tuning()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components of documents whose shingle sets have Jaccard similarity of 0.8 or more.

    A-Z are lower-cased; words are runs of what is not ASCII white space; the set of a document holds its
    distinct five-word shingles, or its whole word sequence if that is shorter. Documents without words or with
    a null text have an empty set and are linked with nothing. The component id is the smallest key reachable.
    Whole texts are used; rows with equal sets are one node; repeated keys are rows of their own; null keys never
    name a component unless all its keys are null; an empty table gives an empty result; other columns are ignored.
    """
    members, placed, _ = _placed(docs, key, text, tuning)
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(names, "root").select("node", "component_id")
    return members.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _digested_by(identity: Identity):
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, firsts in _text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(firsts)), pa.array(identity.of(tokens, firsts)), part.column(2)], ["doc_id", "n", "node", "row"])

    return digested


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of smallest key, a null key being the last, and then of smallest set digest.

    Of rows equal in both one stays. Rows with an empty set are components of their own, so all stay. Rows of
    other components stay even if they repeat a key or have a null one. All columns stay as they are.

    Rows are found by their keys; only those whose key stands on several rows have their sets made once more.
    """
    members, placed, identity = _placed(docs, key, text, Tuning())
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "node")).alias("r")).select(F.col("r.node").alias("node"), F.col("r.rep").alias("rep"))
    first = written(first, "first")
    marked = members.select("doc_id", "n", "node").join(first.withColumn("chosen", F.lit(True)), "node", "left")
    stays = (F.col("n") == 0) | (F.coalesce("chosen", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("rep")))
    found = marked.groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("rows")).where("stays")
    found = written(found.select("doc_id", "rows"), "kept")

    def of(ids: DataFrame) -> DataFrame:
        return docs.join(_small(ids, ids.count()), docs[key].eqNullSafe(ids["doc_id"]), "left_semi")

    repeated = found.where("rows > 1")
    if repeated.isEmpty():
        return of(found)
    schema = StructType().add("doc_id", docs.schema[key].dataType).add("n", "long").add("node", "long").add("row", docs.schema)
    made = of(repeated).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.struct("*").alias("row")).mapInArrow(_digested_by(identity), schema)
    made = written(made, "repeated")
    chosen = made.where("n > 0").join(first, (made["node"] == first["node"]) & made["doc_id"].eqNullSafe(first["rep"]), "left_semi").dropDuplicates(["doc_id", "node"])
    return of(found.where("rows = 1")).unionByName(chosen.unionByName(made.where("n = 0")).select("row.*"))
