"""Exact top-k search by inner product over integer vectors, with block-at-a-time pruning.

Vectors are laid out in blocks of BLOCK consecutive vec_ids, the forward indexes, each with the least
and greatest value of every dimension. For a query, the sum over dimensions of the larger of
q * greatest and q * least bounds every score in a block. Each task orders its blocks by that bound,
query by query, and scores them block by block until the bound falls below the query's k-th score.
The k-th score starts from an exact search among a few vectors, so pruning works across tasks too.

The query set is met in chunks of QUERIES: each chunk is one pass over the blocks, and it alone is
sent to the tasks, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

BLOCK, QUERIES, SEEDS, TOGETHER = 256, 32_768, 2_048, 512
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * component) of usable vectors, one row per vec_id."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(usable & finite).select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _block(group: pa.Table) -> pa.Table:
    """The forward index of one block: ids and a matrix, by vec_id."""
    order = np.argsort(group.column("vec_id").to_numpy(), kind="stable")
    ids = group.column("vec_id").to_numpy()[order]
    m = np.array(group.column("v").to_pylist(), np.int64)[order]
    cells = [[x.tobytes()] for x in (ids, m, m.max(0), m.min(0))]
    return pa.table([pa.array([m.shape[1]], pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=["size", "ids", "matrix", "most", "least"])


def blocks(vectors: DataFrame) -> DataFrame:
    """Forward indexes of BLOCK consecutive vec_ids each, of one vector length."""
    placed = vectors.withColumn("block", F.floor(F.col("vec_id") / BLOCK)).withColumn("size", F.size("v"))
    return placed.groupBy("block", "size").applyInArrow(_block, "size int, ids binary, matrix binary, most binary, least binary")


#: Below every score; and what stands for a score too low for 64 bits, which is an error only if it is among the best.
NONE = np.iinfo(np.int64).min
TOO_LOW = NONE + 1


def products(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, NONE for rows of one id. Floats take part where every sum on
    the way stays below 2**53, so that they are exact as well. 64-bit sums that wrap around on the way are right
    if the product fits, which floats tell but for the few near the edge; one that is too high is an error."""
    own = a_ids[:, None] == b_ids[None, :]
    most = [float(np.abs(x.astype(float)).max()) if x.size else 0.0 for x in (a, b)]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 2**53:
        out = (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    else:
        with np.errstate(over="ignore"):
            out = a @ b.T
        if bound >= 2**62:
            rough = a.astype(float) @ b.T.astype(float)
            slack = 4 * a.shape[1] * np.finfo(float).eps * (np.abs(a.astype(float)) @ np.abs(b.astype(float)).T)
            for i, j in zip(*np.nonzero((np.abs(rough) + slack >= 2**63) & ~own)):
                exact = sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist()))
                if exact >= 2**63:
                    raise OverflowError(f"the score of query {a_ids[i]} and vector {b_ids[j]} doesn't fit in 64 bits: {exact}")
                out[i, j] = max(exact, TOO_LOW)
    out[own] = NONE
    return out


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """No score of a query in a block is above this. The slack covers what rounding may lose."""
    q, most, least = queries.astype(float), most.astype(float), least.astype(float)
    bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    return bound + 1e-12 * (np.abs(q) @ np.maximum(np.abs(most), np.abs(least)).T)


class TopK:
    """The k best of each query so far: scores high to low, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, 0), NONE), np.zeros((n, 0), np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.scores.shape[1] < self.k:
            pad = self.k - self.scores.shape[1]
            self.scores = np.pad(self.scores, ((0, 0), (0, pad)), constant_values=NONE)
            self.ids = np.pad(self.ids, ((0, 0), (0, pad)), constant_values=np.iinfo(np.int64).max)
        s = np.concatenate((self.scores[rows], scores), 1)
        i = np.concatenate((self.ids[rows], np.broadcast_to(ids, scores.shape)), 1)
        order = np.lexsort((i, ~s))[:, : self.k]  # ~s falls as s rises, and can't overflow
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(queries: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, index: list[tuple], k: int) -> TopK:
    """The k best of some blocks for each query, its own id left out; floor is a known lower bound
    of each query's k-th score over all blocks."""
    top = TopK(len(queries), k)
    bound = bounds(queries, *(np.stack([b[n] for b in index]) for n in (2, 3)))
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(queries))
    for r in range(len(index)):
        b = order[active, r]
        kth = np.maximum(floor[active], top.scores[active, -1] if top.scores.shape[1] == k else NONE)
        going = bound[active, b] >= kth  # an equal score may still win by a smaller id
        active, b = active[going], b[going]
        if not len(active):
            break
        for one in np.unique(b).tolist():
            rows = active[b == one]
            ids, matrix = index[one][0], index[one][1]
            top.add(rows, products(queries[rows], matrix, q_ids[rows], ids), ids)
    return top


def _search(sent, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, queries, floor = sent.value
        size, index = queries.shape[1], []

        def some() -> pa.RecordBatch:
            out = []
            for at in range(0, len(q_ids), 4096):  # bounds of a slice of the queries at a time
                part = slice(at, at + 4096)
                top = search(queries[part], q_ids[part], floor[part], index, k)
                good = (top.scores > NONE) & (top.scores >= floor[part][:, None])
                row, column = np.nonzero(good)
                out.append((q_ids[part][row], top.ids[row, column], top.scores[row, column]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_FOUND)

        for batch in batches:
            for n, ids, matrix, most, least in zip(*(c.to_pylist() for c in batch.columns)):
                if n != size:
                    continue
                ids = np.frombuffer(ids, np.int64)
                index.append((ids, np.frombuffer(matrix, np.int64).reshape(len(ids), n), np.frombuffer(most, np.int64), np.frombuffer(least, np.int64)))
                if len(index) >= TOGETHER:
                    yield some()
                    index.clear()
        if index:
            yield some()

    return task


def _chunks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and vectors, at most QUERIES at a time and of one length."""
    for (size,) in queries.select(F.size("v")).distinct().collect():
        ids, rows = [], []
        for i, v in queries.where(F.size("v") == size).orderBy("vec_id").toLocalIterator():
            ids.append(i)
            rows.append(np.array(v, np.int64))
            if len(ids) == QUERIES:
                yield np.array(ids, np.int64), np.stack(rows)
                ids, rows = [], []
        if ids:
            yield np.array(ids, np.int64), np.stack(rows)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's candidates; tasks drop the others before the shuffle."""
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    message = F.format_string("the score of query %d and vector %d doesn't fit in 64 bits", "query_id", "vec_id")
    score = F.when(F.col("score") == TOO_LOW, F.raise_error(message).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by inner product, ties to the
    smaller vec_id; fewer if there are fewer.

    Takes vec_id and embedding. Null vectors, empty ones and ones with null or non-finite components
    take no part; vectors of different lengths aren't compared. A repeated vec_id counts once, with
    its least vector. Components are 64-bit integers; a score among the best that doesn't fit in 64 bits is an error
    that names its ids, one that is too low to be among them is none. Other
    columns are left out; no queries or no vectors give no rows. The jobs run when this is called."""
    spark = vectors.sparkSession
    whole = materialize(quantised(vectors), "vectors")
    index = materialize(blocks(whole), "blocks")
    parts = []
    for q_ids, queries in _chunks(whole.where(is_query)):
        few = min(len(q_ids), SEEDS)
        floor = np.full(len(q_ids), NONE)
        if few > k:
            for at in range(0, len(q_ids), 4096):
                s = products(queries[at : at + 4096], queries[:few], q_ids[at : at + 4096], q_ids[:few])
                floor[at : at + 4096] = np.partition(s, few - k, axis=1)[:, few - k]
        sent = spark.sparkContext.broadcast((q_ids, queries, floor))
        # written at once, so that the driver holds one chunk of queries at a time
        parts.append(materialize(_ranked(index.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long"), k), "found"))
        sent.destroy()
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
