"""Exact nearest neighbours.

A search is scan, project, bounded top-k: each partition keeps k rows, only
those meet. Ties are broken by id; a NaN score sorts last. Many queries at once
are scored in Arrow batches by one matrix product each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics
from ..model import Metric

#: Vectors that meet a block of queries at once, bytes of the scores they make (a task
#: holds some six times that), and bytes of queries and what is held for them that one
#: scan of the vectors carries along (more take another scan each).
BLOCK_ROWS, QUERY_BLOCK_BYTES, QUERY_SCAN_BYTES = 4096, 8 << 20, 64 << 20
#: Bytes of a row that is held for a query.
HELD_BYTES = 24
#: Error of a matrix product's entry, for its operands' lengths, at most.
PRODUCT_ERROR = 1e-5


def best_first(score: str = "score") -> list[Column]:
    s = F.col(score)
    return [F.when(~F.isnan(s), s).desc_nulls_last(), F.col("id").asc()]


def scored(vectors: DataFrame, query: Column, metric: Metric, precision: str = "float32") -> DataFrame:
    return vectors.withColumn("score", metrics.score(metric, F.col("vector"), query, precision))


def search(vectors: DataFrame, query: Column, k: int, metric: Metric, precision: str = "float32") -> DataFrame:
    """The k best rows of ``vectors`` (id, vector, ...)."""
    return scored(vectors, query, metric, precision).orderBy(*best_first()).limit(k)


#: Components scanned (rows times dimension) from which a search is scored in
#: Arrow batches: lambdas in the JVM take some 0.3 s a million components.
BATCHED_FROM = 10_000_000


def batch_search(vectors: DataFrame, query: Sequence[float], k: int, metric: Metric) -> DataFrame:
    """The rows of :func:`search` in single precision, scored by numpy a batch at
    a time. Additions run over components in the same order, for all rows of a
    batch at once, so scores are the same bits; a batch passes on its k best."""
    q = np.array(query, np.float32)
    names = vectors.columns
    at, id_at = names.index("vector"), names.index("id")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.ascontiguousarray(b.column(at).flatten().to_numpy().reshape(b.num_rows, -1).T, np.float32)
            s = sequential_scores(x, q, metric)
            best = np.lexsort((b.column(id_at).to_numpy(), -s))[:k]
            kept = b.take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(s[best])], [*names, "score"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("score", T.FloatType())])
    return vectors.mapInArrow(run, schema).orderBy(*best_first()).limit(k)


def sequential_scores(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Scores of the columns of ``x``, accumulated component by component in its
    precision. ``q`` is one query or has a column for each of ``x``."""
    dot, own, far, qq = (np.zeros(x.shape[1], x.dtype) for _ in range(4))
    for row, y in zip(x, q, strict=True):
        if metric is Metric.EUCLIDEAN:
            far += (row - y) * (row - y)
        else:
            dot += row * y
        if metric is Metric.COSINE:
            own += row * row
            qq += y * y
    if metric is Metric.DOT_PRODUCT:
        return dot
    if metric is Metric.EUCLIDEAN:
        return x.dtype.type(1) / (x.dtype.type(1) + np.sqrt(far))
    norm = np.sqrt(own) * np.sqrt(qq)
    return np.divide(dot, norm, out=np.zeros_like(dot), where=norm != 0)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, metric: Metric, block_bytes: int = QUERY_BLOCK_BYTES, scan_bytes: int = QUERY_SCAN_BYTES, precision: str = "float32") -> DataFrame:
    """qid, id, score, rank of the k best vectors of every query (qid, vector).

    A stated query set is held against all vectors in blocks of bounded size:
    some vectors meet a block in one matrix product, which leaves out what can't
    be among its k best; the rest is scored as a search does, bit for bit, and a
    task keeps the k best so far, equal scores by id. So what is shuffled is k
    rows per query and task, a task's memory doesn't grow with the number of
    queries or vectors, and results are those of single searches.
    """
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<float>").alias("vector"))
    size = q.agg(F.coalesce(F.sum(F.size("vector") * 4 + 8 + HELD_BYTES * k), F.lit(0)).alias("b")).first()
    n_scans = max(1, -(-int(size["b"]) // scan_bytes))
    out = None
    for scan in range(n_scans):
        part = q if n_scans == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(n_scans)) == scan)
        t = part.toArrow()
        found = vectors.select("id", "vector").mapInArrow(_scorer(vectors, t.column(0).to_numpy(), matrix(t.column(1)), k, metric, block_bytes, precision), f"qid long, id long, score {'float' if precision == 'float32' else 'double'}")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(W.partitionBy("qid").orderBy(*best_first()))
    return out.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of a matrix, made without a Python object a component."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0), np.float32)
    lengths = pc.list_value_length(column)
    if column.null_count or pc.min(lengths) != pc.max(lengths):
        raise ValueError("Vector lengths differ")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32, copy=False)


def _scorer(df: DataFrame, qid: np.ndarray, q: np.ndarray, k: int, metric: Metric, block_bytes: int, precision: str):
    shared = df.sparkSession.sparkContext.broadcast((qid, q))
    step = max(1, block_bytes // (4 * BLOCK_ROWS))

    def run(batches):
        qid, q = shared.value
        held = {}  # by a block's first query
        for b in batches if k else ():
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            for lo in range(0, len(ids), BLOCK_ROWS):
                for at in range(0, len(qid), step):
                    row, col, s = best_of_block(x[lo : lo + BLOCK_ROWS], ids[lo : lo + BLOCK_ROWS], q[at : at + step], k, metric, precision)
                    some = row, ids[lo + col], s
                    if at in held:
                        some = [np.concatenate(both) for both in zip(held[at], some, strict=True)]
                        best = k_best(*some, k)
                        some = tuple(a[best] for a in some)
                    held[at] = some
        for at, (row, id_, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(qid[at + row]), pa.array(id_), pa.array(s)], ["qid", "id", "score"])

    return run


def k_best(row: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each row are, ties by id."""
    order = np.lexsort((ids, -s, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def best_of_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, metric: Metric, precision: str = "float32") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, ties by id."""
    about, error = _nearness(x, q, metric)
    keep = min(k, len(ids))
    cut = -np.partition(-(about - error), keep - 1, axis=1)[:, keep - 1]
    row, col = np.nonzero(~(about + error < cut[:, None]))
    s = _pair_scores(x, q, row, col, metric, precision)
    best = k_best(row, ids[col], s, k)
    return row[best], col[best], s[best]


def _nearness(x: np.ndarray, q: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Something that grows with the score, queries by rows, and how far off it
    can be."""
    if metric is Metric.EUCLIDEAN:
        mean = x.mean(axis=0)  # or large components would drown small distances
        x, q = x - mean, q - mean
    xx, qq = ((m * m).sum(axis=1) for m in (x, q))
    dot, lengths = q @ x.T, np.sqrt(qq)[:, None] * np.sqrt(xx)[None, :]
    if metric is Metric.DOT_PRODUCT:
        return dot, PRODUCT_ERROR * lengths
    if metric is Metric.COSINE:
        return np.divide(dot, lengths, out=np.zeros_like(dot), where=lengths > 0), np.full_like(dot, PRODUCT_ERROR)
    both = qq[:, None] + xx[None, :]
    return 2 * dot - both, 2 * PRODUCT_ERROR * both


def _pair_scores(x: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray, metric: Metric, precision: str = "float32") -> np.ndarray:
    """:func:`sequential_scores` of the pairs of query ``row`` and vector ``col``."""
    out = np.empty(len(row), precision)
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = sequential_scores(np.ascontiguousarray(x[col[part]].T, precision), np.ascontiguousarray(q[row[part]].T, precision), metric)
    return out
