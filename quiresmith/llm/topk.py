"""Exact top-k inner-product search by distributed histogram selection (operator 10).

Every pass scores every candidate against a block of queries. The first pass
finds each query's score range; the following ones count scores in histogram
bins over the interval known to hold the k-th value and shrink that interval
to one bin, until it is a single score. The last pass keeps what is above that
score, and as many ties as are needed, by smallest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.session import work_path

BLOCK_QUERIES = 2048
BINS = 512
CHUNK_ROWS = 1024
EXACT = 2**53


def _matrix(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, quantised vectors) by dimension."""
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * scale)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    keys = ids.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield keys[rows], flat[starts[rows][:, None] + np.arange(size)]


def _scores(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products as int64; exact below 2**53, else by Python integers, held within int64."""
    most = max(1.0, np.abs(candidates).max(initial=0)) * max(1.0, np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
    if most < EXACT:
        return (candidates @ queries.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    products = whole(candidates) @ whole(queries).T
    return np.clip(products, -(2**63), 2**63 - 1).astype(np.int64)


class _Block:
    """A bounded block of queries, sent to every task."""

    def __init__(self, keys: list, vectors: list, scale: int):
        self.keys = np.asarray(keys, dtype=np.int64)
        self.scale = scale
        sizes = np.asarray([len(v) for v in vectors])
        self.by_size = {int(n): (rows := np.flatnonzero(sizes == n), np.floor(np.asarray([vectors[i] for i in rows], dtype=np.float64).reshape(len(rows), n) * scale)) for n in np.unique(sizes)}

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query rows, candidate ids, scores by candidate and query, whether the pair counts)."""
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                for ids, matrix in _matrix(part.column(0), part.column(1), self.scale):
                    if matrix.shape[1] in self.by_size:
                        rows, queries = self.by_size[matrix.shape[1]]
                        yield rows, ids, _scores(matrix, queries), ids[:, None] != self.keys[rows][None, :]


def _pass(candidates: DataFrame, schema: str, task: Callable) -> DataFrame:
    return candidates.mapInArrow(task, schema)


def _ranges(block: _Block) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.keys)
        low, high, count = np.full(n, 2**63 - 1), np.full(n, -(2**63)), np.zeros(n, np.int64)
        for rows, _, scores, counts in block.scored(batches):
            low[rows] = np.minimum(low[rows], np.where(counts, scores, 2**63 - 1).min(0, initial=2**63 - 1))
            high[rows] = np.maximum(high[rows], np.where(counts, scores, -(2**63)).max(0, initial=-(2**63)))
            count[rows] += counts.sum(0)
        q = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, low[q], high[q], count[q])], ["q", "low", "high", "n"])

    return task


def _histogram(block: _Block, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(block.keys) * BINS, np.int64)
        for rows, _, scores, valid in block.scored(batches):
            inside = valid & (scores >= low[rows]) & (scores <= high[rows])
            c, q = np.nonzero(inside)
            r = rows[q]
            counts += np.bincount(r * BINS + (scores[c, q] - low[r]) // width[r], minlength=len(counts))
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hit // BINS, hit % BINS, counts[hit])], ["q", "bin", "n"])

    return task


def _keep(block: _Block, kth: np.ndarray, k: int) -> Callable:
    def best(parts: list[np.ndarray]) -> np.ndarray:
        """The k best of each query."""
        rows = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        return rows[:, np.arange(rows.shape[1]) - first < k]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for rows, ids, scores, valid in block.scored(batches):
            c, q = np.nonzero(valid & (scores >= kth[rows]))
            parts.append(best([np.stack([rows[q], scores[c, q], ids[c]])]))
            if len(parts) > 64:
                parts = [best(parts)]
        found = best(parts)
        yield pa.RecordBatch.from_arrays([pa.array(block.keys[found[0]]), pa.array(found[0]), pa.array(found[2]), pa.array(found[1])], ["query_id", "q", "vec_id", "score"])

    return task


def usable(vector: str) -> Column:
    """Vectors that take part: not null, all components present and finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & finite


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k candidates of highest integer inner product for each query.

    Components become floor(scale * x). Queries are the rows where ``is_query``
    holds, candidates all rows with another key and the same dimension. Returns
    ``query_id, rank, vec_id, score``; ties go to the smaller id; with fewer than
    k candidates all are returned. Rows with a null key or a vector that is null
    or holds null or non-finite components take no part. Repeated rows are
    candidates each; a repeated query is answered once. Empty tables give an
    empty result; other columns are ignored.

    Queries go to the tasks in blocks of at most ``block_queries``, whatever
    their number; each block's answer is appended to a table in the shared folder.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_q"))
    candidates = rows.select("id", "v")
    queries = rows.where("is_q").select("id", "v").dropDuplicates()
    path = work_path(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    keys, found = [], []
    for row in queries.toLocalIterator():
        keys.append(row[0])
        found.append(row[1])
        if len(keys) == block_queries:
            _answer(candidates, _Block(keys, found, scale), k).write.mode("append").parquet(path)
            keys, found = [], []
    if keys:
        _answer(candidates, _Block(keys, found, scale), k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _answer(candidates: DataFrame, block: _Block, k: int) -> DataFrame:
    n = len(block.keys)
    low, high, need = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    ranges = _pass(candidates, "q long, low long, high long, n long", _ranges(block)).groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n"))
    for q, a, b, count in ranges.collect():
        low[q], high[q], need[q] = a, b, min(k, count)
    while (low < high).any():
        width = (high - low) // BINS + 1
        bins = _pass(candidates, "q long, bin long, n long", _histogram(block, low, high, width)).groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        bounds = candidates.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "q long, need long")
        kth = bins.withColumn("above", above).join(F.broadcast(bounds), "q").where("above >= need").groupBy("q").agg(F.max(F.struct("bin", "n", "above")).alias("b"))
        for q, (at, count, upto) in kth.collect():
            need[q] -= upto - count
            low[q] += at * width[q]
            high[q] = min(high[q], low[q] + width[q] - 1)
    kept = _pass(candidates, "query_id long, q long, vec_id long, score long", _keep(block, low, k))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
