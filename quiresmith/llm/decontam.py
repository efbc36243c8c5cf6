"""Benchmark decontamination with an FM-index per training shard (operator 7).

The words of a shard of documents form a text over the vocabulary of the
benchmark; words outside it can be in no window, so only runs of known words
long enough to hold a window are indexed. The index is the Burrows-Wheeler
transform in a wavelet matrix with rank tables, plus text positions for a
sample of suffixes. All windows are searched backward together; occurrences
are walked to sampled positions, and the word spans of each document merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.files import Input, Output
from quiresmith.llm.textvec import LOWER, byte_class, packed, slices, word_hashes, word_spans
from quiresmith.session import work_path

WORD_BYTES = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
WINDOW = 13
SAMPLE_STEP = 16
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 8 << 20
GROUP_BYTES = 32 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and the total)."""
    data, offsets = packed(texts)
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, offsets, WORD_BYTES)
    return word_hashes(data, starts, ends), firsts


class Windows:
    """The distinct windows of a bounded block of benchmark items."""

    def __init__(self, item_ids: list[str | None], texts: list[str], width: int):
        hashes, firsts = _words(pa.array(texts, pa.string()))
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols + 1  # 0 separates runs
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        by_pattern: dict[tuple, set[str]] = {}
        for i, item in enumerate(item_ids):
            words = symbols[firsts[i] : firsts[i + 1]].tolist()
            for at in range(max(1, len(words) - width + 1) if words else 0):
                by_pattern.setdefault(tuple(words[at : at + width]), set()).update([] if item is None else [item])
        self.patterns = [np.asarray(p, np.int64) for p in by_pattern]
        self.items = [sorted(x) for x in by_pattern.values()]
        self.lengths = np.asarray([len(p) for p in self.patterns], np.int64)
        self.shortest = int(self.lengths.min(initial=width))
        self.table = np.zeros((len(self.patterns), width), np.int64)
        for i, p in enumerate(self.patterns):
            self.table[i, width - len(p) :] = p

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Word hash -> symbol, -1 for words of no item."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)]) if len(self.vocabulary) else np.zeros(0, np.int64)
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == hashes[maybe] if len(maybe) else np.zeros(0, bool)
        out[maybe[hit]] = at[hit] + 1
        return out


class FMIndex:
    """Counts and locates patterns in a text of symbols 1.. with separators 0; the text must end with a separator."""

    def __init__(self, text: np.ndarray, step: int = SAMPLE_STEP):
        n = len(text)
        order = self._suffixes(text)
        last = text[order - 1]
        last[order == 0] = 0
        self.size = n
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.bits, self.zeros, self.ones_from = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(~bit, out=zeros[1:])
            self.bits.append(bit)
            self.zeros.append(zeros)
            self.ones_from.append(int(zeros[-1]))
            last = np.concatenate([last[~bit], last[bit]])
        self.begin = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))
        starts_run = np.ones(n, bool)
        starts_run[1:] = text[:-1] == 0
        self.sampled = (starts_run | (np.arange(n) % step == 0))[order]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; every separator is a symbol of its own, before all words."""
        n = len(text)
        gaps = np.flatnonzero(text == 0)
        rank = text + len(gaps)
        rank[gaps] = np.arange(len(gaps))
        reach = 1
        while True:
            behind = np.zeros(n, np.int64)
            behind[:-reach or None] = rank[reach:] + 1
            key = rank * (n + int(text.max(initial=0)) + 2) + behind
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[False], ordered[1:] != ordered[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            reach *= 2
            if fresh[1:].all() or reach >= n:
                return order

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position of the top level stands in the last level, on the way of each symbol."""
        for depth in range(self.levels):
            bit = symbols >> (self.levels - 1 - depth) & 1
            zeros = self.zeros[depth][at]
            at = np.where(bit == 1, self.ones_from[depth] + at - zeros, zeros)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a row of the transform."""
        return self._down(symbols, at) - self.begin[symbols]

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns, by backward search of all at once."""
        low, high = np.zeros(len(table), np.int64), np.full(len(table), self.size, np.int64)
        width = table.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                continue
            c = table[live, width - 1 - step]
            known = c < len(self.begin)
            high[live[~known]] = 0
            live, c = live[known], c[known]
            low[live] = self.smaller[c] + self.rank(c, low[live])
            high[live] = self.smaller[c] + self.rank(c, high[live])
        return low, np.maximum(low, high)

    def _step_back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer."""
        at, symbol = rows, np.zeros(len(rows), np.int64)
        for depth in range(self.levels):
            bit = self.bits[depth][at]
            zeros = self.zeros[depth][at]
            symbol = symbol * 2 + bit
            at = np.where(bit, self.ones_from[depth] + at - zeros, zeros)
        return self.smaller[symbol] + at - self.begin[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.sample_rank[at[done]]] + steps[todo[done]]
            todo, at = todo[~done], self._step_back(at[~done])
            steps[todo] += 1
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of [low, high) ranges, and which range each is of."""
    sizes = high - low
    of = np.repeat(np.arange(len(low)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of], of


def _search_shard(windows: Windows, symbols: np.ndarray, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, first word, length, pattern) of every occurrence in a shard.

    symbols, doc and word are those of the words of the kept runs, separators included.
    """
    index = FMIndex(symbols)
    low, high = index.search(windows.table, windows.lengths)
    hit = np.flatnonzero(high > low)
    rows, of = _ranges(low[hit], high[hit])
    pattern = hit[of]
    at = index.locate(rows)
    return doc[at], word[at], windows.lengths[pattern], pattern


def _kept_runs(symbols: np.ndarray, firsts: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of runs of known words with at least ``shortest``: (symbol, text, place in the text), a separator after each run."""
    n = len(symbols)
    known = symbols >= 0
    text_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    fresh = np.ones(n, bool)
    fresh[1:] = ~(known[1:] & known[:-1] & (text_of[1:] == text_of[:-1]))
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, n))
    keep = known[heads] & (sizes >= shortest) if n else np.zeros(0, bool)
    heads, sizes = heads[keep], sizes[keep]
    at, run = _ranges(heads, heads + sizes)
    total = len(at) + len(heads)
    place = np.arange(len(at)) + run
    out = [np.zeros(total, np.int64) for _ in range(3)]
    for target, values in zip(out, (symbols[at], text_of[at], at - firsts[text_of[at]]), strict=True):
        target[place] = values
    return out[0], out[1], out[2]


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, first word of each text and the total) of slices of texts."""
    base = 0
    for part in slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0):
        yield base, *_words(part.column(0))
        base += part.num_rows


def _scan_words(windows: Windows, parts: Iterable[tuple[int, np.ndarray, np.ndarray]], n_texts: int) -> tuple[list[list[tuple[int, int]]], list[set[str]], np.ndarray]:
    """Spans and items of each text, and its number of words."""
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    items: list[set[str]] = [set() for _ in range(n_texts)]
    counts = np.zeros(n_texts, np.int64)
    pending: list[tuple[np.ndarray, ...]] = []

    def flush() -> None:
        if not pending:
            return
        symbols, doc, word = (np.concatenate(x) for x in zip(*pending, strict=True))
        pending.clear()
        if not len(symbols):
            return
        d, w, length, pattern = _search_shard(windows, symbols, doc, word)
        for a, b in np.unique(np.stack([d, pattern], 1), axis=0):
            items[a].update(windows.items[b])
        order = np.lexsort((w, d))
        for a, b, c in np.unique(np.stack([d, w, length], 1)[order], axis=0):
            spans[a].append((int(b), int(c)))

    for base, hashes, firsts in parts:
        counts[base : base + len(firsts) - 1] = np.diff(firsts)
        symbols, doc, word = _kept_runs(windows.symbols(hashes), firsts, windows.shortest)
        pending.append((symbols, doc + base, word))
        if sum(len(p[0]) for p in pending) >= SHARD_WORDS:
            flush()
    flush()
    return spans, items, counts


def _scan_batch(windows: Windows, texts: pa.Array) -> tuple[list[list[tuple[int, int]]], list[set[str]], np.ndarray]:
    return _scan_words(windows, _hashed(texts), len(texts))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (start, length) spans with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b - a) for a, b in out]


def _blocks(benchmark: DataFrame, item: str, text: str, width: int, most: int) -> list[tuple[str, int]]:
    """Files with the windows of the benchmark in the shared folder, each of about ``most`` bytes of text (or one item); items are dealt out by hash."""
    rows = benchmark.where(F.octet_length(text) > 0).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    folder = work_path(benchmark.sparkSession, "windows")

    def store(block: pa.Table) -> pa.Table:
        out = Output(folder, ".windows")
        out.write(pickle.dumps(Windows(block["i"].to_pylist(), block["t"].to_pylist(), width)))
        out.close()
        return pa.table({"uri": [out.uri], "size": [out.offset]}, schema=pa.schema([("uri", pa.string()), ("size", pa.int64())]))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(-(-size // most) or 1)))
    return [(r.uri, r.size) for r in dealt.groupBy("block").applyInArrow(store, "uri string, size long").collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: Sequence[str] = ()) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    Lower-cases A-Z; words are runs of ASCII digits and letters and of non-ASCII
    characters. A window is ``width`` consecutive words of an item; an item with
    fewer words, but some, is one window. Returns ``key, n_words, n_hit, spans,
    items``: the words inside any occurrence, the merged removal spans (first
    word, number of words) and the sorted ids of the items found. Null and empty
    texts have no words and no hits; items with null or empty texts and repeated items add
    nothing; one without an id hits, but there is no id to list; an empty benchmark finds nothing; rows that repeat are judged each.
    Columns named in ``keep`` are carried along, but for those named like a result; others are ignored.

    The windows are files of about ``block_bytes`` of text in the shared folder. One pass over the documents reads them one after another for every
    few documents, so a task holds one of them and a benchmark of any size; one that is alone stays in the worker. No shuffle of documents.
    """
    keep = [c for c in keep if c not in (key, "n_words", "n_hit", "spans", "items")]
    own = [f"c{i}" for i in range(len(keep))]
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *(F.col(c).alias(o) for c, o in zip(keep, own, strict=True)), F.array().cast("array<struct<start:long,length:long>>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    found = found.mapInArrow(_scan(_blocks(benchmark, item, item_text, width, block_bytes)), schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return found.select(F.col("k").alias(key), *(F.col(o).alias(c) for c, o in zip(keep, own, strict=True)), "n_words", n_hit.alias("n_hit"), "spans", "items")


def _load(uri: str, size: int) -> Windows:
    source = Input(uri)
    try:
        return pickle.loads(source.read(0, size))
    finally:
        source.close()


@lru_cache(maxsize=1)
def _kept(uri: str, size: int) -> Windows:
    return _load(uri, size)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about ``most`` bytes of text, at least one batch each."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.column(1).nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _scan(blocks: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for group in _groups(batches, GROUP_BYTES if len(blocks) > 1 else 0):
            texts = [batch.column(1) for batch in group]
            spans = [[[] for _ in range(len(t))] for t in texts]
            items = [[set() for _ in range(len(t))] for t in texts]
            counts = [None] * len(group)
            hashed = [_hashed(t) if len(blocks) == 1 else list(_hashed(t)) for t in texts]
            for block in blocks:
                windows = _kept(*block) if len(blocks) == 1 else _load(*block)
                for g, words in enumerate(hashed):
                    more, ids, counts[g] = _scan_words(windows, words, len(texts[g]))
                    for mine, new in zip(spans[g], more, strict=True):
                        mine += new
                    for known, new in zip(items[g], ids, strict=True):
                        known |= new
                del windows
            for g, batch in enumerate(group):
                if counts[g] is None:  # an empty benchmark
                    counts[g] = np.concatenate([np.diff(firsts) for _, _, firsts in hashed[g]] or [np.zeros(0, np.int64)])
                spans_out = pa.array([[{"start": a, "length": b} for a, b in merged(x)] for x in spans[g]], span_type)
                ids_out = pa.array([sorted(x) for x in items[g]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], spans_out, ids_out, pa.array(counts[g])], batch.schema.names)

    return run


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``contaminated``: some word is hit, and at least one in ``share``."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between those of one span."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts, ends, _ = word_spans(LOWER[raw], np.asarray([0, len(raw)]), WORD_BYTES)
    out, at = [], 0
    for first, length in spans:
        out.append(raw[at : starts[first]].tobytes())
        at = ends[first + length - 1]
    return (b"".join(out) + raw[at:].tobytes()).decode("utf-8")
