"""Language of documents by a bidirectional gated recurrent network over bytes (operator 5).

Texts are cut into windows of bytes; one recurrent layer reads each window
forward, one backward; every position is labelled from both states, and the
label probabilities of all letter positions of a document are averaged.
Training is backpropagation through time in numpy. The gates use the
piecewise linear sigmoid, so that inference needs one tanh per unit and step.
All arrays are (units, windows): each step works on many windows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.sampling import bounded_sample, class_counts, within_bytes
from quiresmith.llm.textvec import byte_class, packed, pieces, slices

WINDOW_BYTES = 48
UNITS = 8
CHUNK_WINDOWS = 4096
SAMPLE_PER_LANG = 500
SAMPLE_BYTES = 64 << 20
LETTER_BYTES = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
UNKNOWN = "und"


class GRU:
    """One direction."""

    def __init__(self, units: int, rng: np.random.Generator):
        self.units = units
        self.table = (rng.standard_normal((3 * units, 256)) * 0.3).astype(np.float32)
        self.table[units : 2 * units] += 1.0  # begin by remembering
        self.u = (rng.standard_normal((3 * units, units)) / np.sqrt(units)).astype(np.float32)

    def forward(self, steps: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """States after each row of ``steps`` (bytes by window); with ``keep`` the layers needed for learning are appended to it."""
        n = self.units
        h = np.zeros((n, steps.shape[1]), np.float32)
        x, g = np.empty((3 * n, steps.shape[1]), np.float32), np.empty((3 * n, steps.shape[1]), np.float32)
        for symbols in steps:
            if keep is not None:
                x, g = np.empty_like(x), np.empty_like(g)
            np.take(self.table, symbols, axis=1, out=x, mode="clip")
            np.matmul(self.u, h, out=g)
            gates = x[: 2 * n]
            gates += g[: 2 * n]
            gates *= 0.2
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            new = gates[:n] * g[2 * n :]
            new += x[2 * n :]
            np.tanh(new, out=new)
            previous, h = h, (h - new) * gates[n:] + new
            if keep is not None:
                keep.append((previous, gates, g[2 * n :], new))
            yield h

    def backward(self, steps: np.ndarray, kept: list, dh_steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the table and of u, given those of the states."""
        n = self.units
        dh, du, dx_all = np.zeros_like(dh_steps[0]), np.zeros_like(self.u), []
        for t in range(len(steps) - 1, -1, -1):
            previous, gates, g_new, new = kept[t]
            r, z = gates[:n], gates[n:]
            dh = dh + dh_steps[t]
            da = dh * (1 - z) * (1 - new * new)
            dz = dh * (previous - new) * 0.2 * ((z > 0) & (z < 1))
            dr = da * g_new * 0.2 * ((r > 0) & (r < 1))
            dg = np.concatenate([dr, dz, da * r])
            dx_all.append(np.concatenate([dr, dz, da]))
            du += dg @ previous.T
            dh = dh * z + self.u.T @ dg
        symbols = steps[::-1].reshape(-1)
        dx = np.concatenate(dx_all, axis=1)
        return np.stack([np.bincount(symbols, row, 256) for row in dx]).astype(np.float32), du


class ByteTagger:
    """Two GRUs and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = GRU(units, rng), GRU(units, rng)
        self.out = (rng.standard_normal((len(languages), 2 * units)) * 0.3).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def weights(self) -> list[tuple[object, str]]:
        return [(self.ahead, "table"), (self.ahead, "u"), (self.back, "table"), (self.back, "u"), (self, "out"), (self, "bias")]

    def probabilities(self, steps: np.ndarray, state: list[np.ndarray], t: int, back: np.ndarray) -> np.ndarray:
        """Label probabilities at one position."""
        n = self.ahead.units
        logits = self.out[:, :n] @ state[t]
        logits += self.out[:, n:] @ back
        logits += self.bias
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits

    def gradients(self, steps: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross entropy over masked positions."""
        n, total = self.ahead.units, max(1.0, float(mask.sum()))
        kept_a: list = []
        kept_b: list = []
        a = list(self.ahead.forward(steps, kept_a))
        b = list(self.back.forward(steps[::-1], kept_b))[::-1]
        d_out, d_bias, da, db, loss = np.zeros_like(self.out), np.zeros_like(self.bias), [], [], 0.0
        at = np.arange(steps.shape[1])
        for t in range(len(steps)):
            p = self.probabilities(steps, a, t, b[t])
            loss -= float((np.log(p[labels, at] + 1e-9) * mask[t]).sum())
            p[labels, at] -= 1
            p *= mask[t] / total
            d_out += p @ np.concatenate([a[t], b[t]]).T
            d_bias += p.sum(1, keepdims=True)
            da.append(self.out[:, :n].T @ p)
            db.append(self.out[:, n:].T @ p)
        ga, gb = self.ahead.backward(steps, kept_a, da), self.back.backward(steps[::-1], kept_b, db[::-1])
        return [*ga, *gb, d_out, d_bias], loss / total

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """Mean label probabilities over the letter positions of every text; zeros where there is none."""
        out = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts))
        for windows, mask, of in window_runs(texts, CHUNK_WINDOWS):
            steps, weight = np.ascontiguousarray(windows.T), np.ascontiguousarray(mask.T)
            ahead = list(self.ahead.forward(steps))
            total = np.zeros((len(self.languages), steps.shape[1]), np.float32)
            for i, back in enumerate(self.back.forward(steps[::-1])):
                t = len(steps) - 1 - i
                total += self.probabilities(steps, ahead, t, back) * weight[t]
            for k, row in enumerate(total):
                out[:, k] += np.bincount(of, row, len(texts))
            letters += np.bincount(of, weight.sum(0), len(texts))
        return out / np.maximum(letters, 1)[:, None]


def window_runs(texts: pa.Array, most: int, size: int = WINDOW_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows of bytes filled up with spaces, mask of letter bytes, text of each window) over whole texts, ``most`` windows at a time."""
    data, offsets = packed(texts)
    for starts, ends, of in pieces(offsets, size, most):
        sizes = ends - starts
        windows = np.full(len(starts) * size, 32, np.uint8)
        first, last = int(starts[0]), int(ends[-1])
        windows[np.arange(first, last) + np.repeat(np.arange(len(starts)) * size - starts, sizes)] = data[first:last]
        windows = windows.reshape(-1, size)
        yield windows, LETTER_BYTES[windows].astype(np.float32), of


def cut(texts: pa.Array, size: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows, whether each holds a letter byte, and texts of windows."""
    empty = (np.zeros((0, size), np.uint8), np.zeros(0, bool), np.zeros(0, np.int32))
    runs = ((windows, mask.any(1), of.astype(np.int32)) for windows, mask, of in window_runs(texts, CHUNK_WINDOWS, size))
    return tuple(np.concatenate(x) for x in zip(empty, *runs, strict=True))


def train(texts: pa.Array, labels: list[str], steps: int = 400, batch: int = 384, rate: float = 0.02, seed: int = 11) -> ByteTagger:
    """Adam on random windows, languages equally often."""
    languages = sorted(set(labels))
    model = ByteTagger(languages, seed=seed)
    if len(languages) < 2:
        return model
    windows, lettered, of = cut(texts)
    y = np.asarray([languages.index(x) for x in labels])[of]
    rows = [np.flatnonzero((y == k) & lettered) for k in range(len(languages))]
    rows = [r for r in rows if len(r)]
    rng = np.random.default_rng(seed)
    places = model.weights()
    first = [np.zeros_like(getattr(o, n)) for o, n in places]
    second = [np.zeros_like(x) for x in first]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(r, batch // len(rows) + 1) for r in rows])
        symbols = np.ascontiguousarray(windows[pick].T)
        grads, _ = model.gradients(symbols, y[pick], LETTER_BYTES[symbols].astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * (1 - step / (steps + 1))
        for i, ((o, n), g) in enumerate(zip(places, grads, strict=True)):
            g = g / max(1.0, norm)
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.005 * (g * g - second[i])
            setattr(o, n, (getattr(o, n) - now * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.995**step)) + 1e-8)).astype(np.float32))
    return model


def fit_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG, sample_bytes: int = SAMPLE_BYTES) -> ByteTagger:
    """Fit on a bounded sample: about ``per_lang`` rows of each language, long ones by windows from everywhere in them if the texts have over ``sample_bytes`` in all.

    Rows with a null language or a null or empty text teach nothing; without any the model knows no language. Whole
    texts are used, of any length; repeated rows count as often as they stand there; ties are ordered by all columns.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(key, text, lang)
    counts = class_counts(known.select(lang), lang)
    rows = within_bytes(bounded_sample(known, lang, key, per_lang, counts), text, 2 * per_lang * max(1, len(counts)), sample_bytes)
    texts, found = pa.array((r[1] for r in rows), pa.large_string()), [r[2] for r in rows]
    del rows
    return train(texts, found)


def identify(docs: DataFrame, model: ByteTagger, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``, the pooled probability of that language.

    Texts that are null or hold no letter get ``und`` with score 0, as does every text if no language was
    learnt. Texts of any length are read whole; repeated rows score alike; equal probabilities go to the
    language first in the alphabet; all columns of ``docs`` stay, and input columns named like the results
    are replaced. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at)
                p = model.pooled(texts) if model.languages else np.zeros((len(texts), 1))
                best = p.argmax(1)
                lettered = [bool(model.languages) and has_letter(t.as_py()) for t in texts]
                lang = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, p.max(1), 0.0) if len(texts) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def has_letter(text: str | None) -> bool:
    """Whether a text holds any letter."""
    return text is not None and any(map(str.isalpha, text))
