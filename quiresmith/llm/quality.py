"""Document quality by attention-based multiple-instance learning (operator 1).

A document is a bag of passages. Each passage is encoded by a small network
over hashed byte pairs, their variety and the length; gated attention weighs the encodings; the weighted sum
is scored. All weights, those of the attention too, are learnt from document
labels by gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.sampling import bounded_sample, class_counts, within_bytes
from quiresmith.llm.textvec import packed, pieces, slices

PASSAGE_BYTES = 192
FEATURES = 512
EXTRA = 3
HIDDEN = 24
SAMPLE_PER_CLASS = 2000
SAMPLE_BYTES = 64 << 20
LEAST_STEPS = 200
RUN_PASSAGES = 2048
_PAIR_BUCKET = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 9)).astype(np.int64)


def passage_runs(texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair counts of passages as uint8, text of each) for runs of at most ``most`` passages; an empty text has one empty passage."""
    data, offsets = packed(texts)
    for starts, ends, text in pieces(offsets, PASSAGE_BYTES, most, least=1):
        first, last = int(starts[0]), int(ends[-1])
        sizes = ends - starts
        passage = np.repeat(np.arange(len(starts)), sizes)
        pair = data[first:last].astype(np.int64)
        pair[1:] += pair[:-1] << 8  # never decoded again: the high byte is cut off below
        if first and last > first:
            pair[0] += int(data[first - 1]) << 8
        pair &= 0xFFFF
        heads = starts[(sizes > 0) & (starts == offsets[text])] - first
        pair[heads] &= 0xFF
        counts = np.bincount(passage * FEATURES + _PAIR_BUCKET[pair], minlength=len(starts) * FEATURES)
        yield np.minimum(counts, 255).astype(np.uint8).reshape(-1, FEATURES), text


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pair counts of all passages, first passage of each text and the total)."""
    runs = list(passage_runs(texts, RUN_PASSAGES))
    text = np.concatenate([np.zeros(0, np.int64), *(t for _, t in runs)])
    return np.concatenate([np.zeros((0, FEATURES), np.uint8), *(c for c, _ in runs)]), np.searchsorted(text, np.arange(len(texts) + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Passage encoder, gated attention and scorer."""

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w, self.b = draw(FEATURES + EXTRA, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.v, self.u, self.a = draw(HIDDEN, HIDDEN), draw(HIDDEN, HIDDEN), draw(HIDDEN)
        self.c, self.d = np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32)
        self.prior = 0.0

    def encode(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Encodings of passages and how much attention asks for them."""
        x = np.sqrt(counts.astype(np.float32))
        x /= np.maximum(1, np.sqrt((x * x).sum(1, keepdims=True)))
        x *= 4
        size = counts.sum(1, dtype=np.float32) / PASSAGE_BYTES
        distinct = np.count_nonzero(counts, axis=1).astype(np.float32) / PASSAGE_BYTES  # few in passages that repeat themselves
        x = np.concatenate([x, np.stack([4 * distinct, 4 * distinct / np.maximum(size, 0.05), size], 1)], 1)
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        return {"x": x, "h": h, "t": t, "g": g, "e": (t * g) @ self.a}

    def forward(self, counts: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for bags of passages."""
        f = self.encode(counts)
        bag = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        e = np.exp(f["e"] - np.maximum.reduceat(f["e"], firsts[:-1])[bag])
        alpha = e / np.add.reduceat(e, firsts[:-1])[bag]
        z = np.add.reduceat(f["h"] * alpha[:, None], firsts[:-1])
        return f | {"alpha": alpha, "bag": bag, "z": z, "logit": z @ self.c + self.d}

    def gradients(self, counts: np.ndarray, firsts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of NAMES."""
        f = self.forward(counts, firsts)
        dlogit = ((_sigmoid(f["logit"]) - labels) / len(labels)).astype(np.float32)
        dz = dlogit[:, None] * self.c
        dz_bag = dz[f["bag"]]
        dalpha = (dz_bag * f["h"]).sum(1)
        de = f["alpha"] * (dalpha - np.add.reduceat(f["alpha"] * dalpha, firsts[:-1])[f["bag"]])
        dtg = de[:, None] * self.a
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = dz_bag * f["alpha"][:, None] + dt @ self.v.T + dg @ self.u.T
        dpre = dh * (1 - f["h"] ** 2)
        return [f["x"].T @ dpre, dpre.sum(0), f["h"].T @ dt, f["h"].T @ dg, (f["t"] * f["g"]).T @ de, f["z"].T @ dlogit, dlogit.sum(keepdims=True)]

    def score(self, texts: pa.Array, most: int = RUN_PASSAGES) -> np.ndarray:
        """Probability of label 1 of every text: attention sums run on from one run of ``most`` passages to the next."""
        top, total, z = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), HIDDEN))
        for counts, text in passage_runs(texts, most):
            f = self.encode(counts)
            heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            rows = text[heads]
            high = np.maximum(top[rows], np.maximum.reduceat(f["e"], heads))
            weight = np.exp(f["e"] - np.repeat(high, np.diff(np.append(heads, len(text)))))
            fade = np.exp(top[rows] - high)
            total[rows] = total[rows] * fade + np.add.reduceat(weight, heads)
            z[rows] = z[rows] * fade[:, None] + np.add.reduceat(f["h"] * weight[:, None], heads)
            top[rows] = high
        return _sigmoid(z / total[:, None] @ self.c + self.d.astype(np.float64) + self.prior)


def train(texts: pa.Array, labels: list[int], prior: float, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> AttentionModel:
    """Adam over mini-batches of bags; ``prior`` is added to the log odds of a class-balanced sample.

    Passages are counted anew for each batch: the counts of the whole sample would take several times the memory of its texts.
    """
    model = AttentionModel(seed)
    model.prior = prior
    if len(set(labels)) < 2:
        return model
    y = np.asarray(labels, np.float32)
    share = y.mean()
    model.prior += float(np.log((1 - share) / share))
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(getattr(model, n)) for n in model.NAMES]
    second = [np.zeros_like(x) for x in first]
    batches = -(-len(y) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    step, total = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            counts, firsts = passages(texts.take(pa.array(docs)))
            step += 1
            now = rate * (1 - step / (total + 1))
            for i, (name, g) in enumerate(zip(model.NAMES, model.gradients(counts, firsts, y[docs]), strict=True)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                setattr(model, name, (getattr(model, name) - now * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel:
    """Fit on a bounded sample: about ``per_class`` rows of each label, long ones by windows from everywhere in them if the texts have over ``sample_bytes`` in all.

    The share of label 1 comes from all rows of ``labels``. Null labels and texts and labels of no document
    teach nothing; with fewer than two labels the model knows their shares only. Whole texts are used, of any
    length; keys that repeat in either table give each pair; ties are ordered by all columns, so the sample is always the
    same. The sample of labels, at most four times ``per_class`` rows, is broadcast to the documents.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_label"))
    counts = class_counts(known, "_label")
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    sample = bounded_sample(known, "_label", key, per_class, counts)
    taken = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(sample), key).select(key, text, "_label")
    rows = within_bytes(taken, text, 4 * per_class, sample_bytes)
    texts, found = pa.array((r[1] for r in rows), pa.large_string()), [r[2] for r in rows]
    del rows
    return train(texts, found, prior)


def score_quality(docs: DataFrame, model: AttentionModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` plus ``score`` (probability of label 1) and ``predicted`` (1 if score >= threshold, else 0).

    Null and empty texts are one empty passage and get the model's score for that; texts of any length are
    scored whole; repeated rows score alike; all columns of ``docs`` stay, and input columns named like the
    results are replaced. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, kept.index(text)):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(part.column(kept.index(text))))], [*kept, "score"])

    return docs.select(*kept).mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
