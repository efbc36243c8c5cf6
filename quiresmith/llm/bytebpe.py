"""Byte-level BPE encoding and decoding (operator 9).

Every match of the split pattern is encoded on its own. Its bytes are mapped
to Latin-1 so that a pyahocorasick automaton over the vocabulary finds the
longest token at every position. Tokens are then taken from left to right;
a token is accepted only if the exact merge procedure would keep it apart
from its left neighbour. That test depends on the two tokens alone and is
memoised. A position that turns out to be a dead end is marked once and never
entered again, so the work is linear in the length of the piece, and the
result equals that of merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MEMO_ENTRIES = 300_000
LONG_PIECE = 256


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by id; the ids must be dense."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class BytePairs:
    """Exact encoder of single pieces over a dense rank table."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * len(tokens)
        self.lengths = [len(t) for t in tokens]
        #: By token: the longest proper prefix that is a token, or -1.
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self._learn_merges()
        #: Whether merging can yield the token at all.
        self.reachable = [len(t) == 1 or h is not None for t, h in zip(tokens, self.halves, strict=True)]

    def _learn_merges(self) -> None:
        """For each token the two tokens that merge into it last; None where merging never yields it."""
        for i, token in enumerate(self.tokens):
            if len(token) < 2:
                continue
            parts = [self.ids.get(token[k : k + 1]) for k in range(len(token))]
            while len(parts) > 2 and None not in parts:
                best, at = i, -1
                for k in range(len(parts) - 1):
                    rank = self.joined.get((parts[k], parts[k + 1]))
                    if rank is not None and rank < best:
                        best, at = rank, k
                if at < 0:
                    break
                parts[at : at + 2] = [best]
            if len(parts) == 2 and None not in parts:
                self.halves[i] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = i

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a boundary between two adjacent tokens.

        The merges that built both tokens are undone from the latest back. If at
        some moment the two parts that touch the boundary have a merge earlier
        than the one undone last, merging would have joined them.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, before, kept = left, right, len(self.tokens), self.reachable[left] and self.reachable[right]
        while kept:
            rank = self.joined.get((a, b))
            if rank is not None and rank < before:
                kept = False
                break
            cut_a, cut_b = self.halves[a], self.halves[b]
            if cut_a is None and cut_b is None:
                break
            # of equal merges the left one happens first, so the right one is undone first
            if cut_b is None or (cut_a is not None and a > b):
                before, a = a, cut_a[1]
            else:
                before, b = b + 1, cut_b[0]
        if len(self.fits) >= MEMO_ENTRIES:
            self.fits.clear()
        self.fits[left, right] = kept
        return kept

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest, found = [0] * size, [-1] * size
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > longest[start]:
                longest[start], found[start] = length, token
        out: list[int] = []
        dead = bytearray(size + 1)
        fits, lengths, shorter = self.fits, self.lengths, self.shorter
        at, token, last = 0, found[0], -1
        while at < size:
            if token < 0:  # nothing more begins here: the last token was wrong
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
                token = shorter[token]
                continue
            end = at + lengths[token]
            if not dead[end]:
                if last < 0:
                    kept = self.reachable[token]
                elif (kept := fits.get((last, token))) is None:
                    kept = self.compatible(last, token)
                if kept:
                    out.append(token)
                    at, last = end, token
                    token = found[at] if at < size else -1
                    continue
            token = shorter[token]
        return out


class _Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = np.asarray(self.pairs.encode(raw), dtype="<u4").tobytes()
        if len(raw) <= LONG_PIECE:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """Text <-> id bytes for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pairs = BytePairs(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.pairs)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """The codec of this worker process, built once."""
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = cls(path, pattern)
        return _CODECS[path, pattern]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pairs.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", with_payload: bool = True) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns ``key, n_tokens, ids_sha256, decoded_sha256`` and, with
    ``with_payload``, also ``ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded`` (the decoded string). A null text counts as the empty text: no
    ids, digests of nothing. Texts of any length are encoded whole; repeated
    rows give repeated results; an empty table gives an empty result; other
    columns are ignored whatever their names. A narrow operation: no shuffle.
    """
    payload = ", ids binary, decoded string" if with_payload else ""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{payload}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            counts, ids_hex, text_hex, ids_out, text_out = [], [], [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                decoded = codec.decode(ids)
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(decoded).hexdigest())
                if with_payload:
                    ids_out.append(ids)
                    text_out.append(decoded.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_payload:
                columns += [pa.array(ids_out, pa.binary()), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, text).mapInArrow(run, schema)
