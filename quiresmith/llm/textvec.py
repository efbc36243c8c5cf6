"""Vectorised work on the words of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20
#: Lower-casing of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_class(keep: list[tuple[int, int]]) -> np.ndarray:
    """Boolean table over bytes: those in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for first, last in keep:
        out[first : last + 1] = True
    return out


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of an array of strings; nulls are empty."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes together; a longer text is a part of its own."""
    texts = batch.column(column).cast(pa.large_string())
    sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0))
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if batch.num_rows > at:
        yield batch.slice(at)


def pieces(offsets: np.ndarray, size: int, most: int, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, text) of the pieces of ``size`` bytes that texts are cut into, ``most`` at a time.

    The last piece of a text may be shorter; each text has at least ``least`` pieces.
    """
    n = np.maximum(least, -(-np.diff(offsets) // size))
    firsts = np.concatenate([[0], np.cumsum(n)])
    for at in range(0, int(firsts[-1]), most):
        piece = np.arange(at, min(at + most, int(firsts[-1])))
        text = np.searchsorted(firsts, piece, "right") - 1
        starts = offsets[text] + size * (piece - firsts[text])
        yield starts, np.minimum(starts + size, offsets[text + 1]), text


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total) of maximal runs of word bytes inside texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts_here, ends_here = inside & ~before, before & ~inside
    edges = np.unique(offsets[1:-1])
    edges = edges[(edges > 0) & (edges < len(data))]
    split = edges[inside[edges] & before[edges]]
    starts_here[split] = True
    ends_here[split] = True
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, independent of where it stands."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right")))
        first = starts[at]
        part = data[first : ends[last - 1]]
        power, inverse = _powers(HASH_BYTES if len(part) <= HASH_BYTES else 1 << int(len(part) - 1).bit_length())
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[part] * power[: len(part)], out=sums[1:])
        a, b = starts[at:last] - first, ends[at:last] - first
        out[at:last] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        at = last
    return mix(out)


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * _BASE % (1 << 64)
        out += words[k : k + n] * np.uint64(factor)
    return mix(out)
