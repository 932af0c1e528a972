"""Nearest vectors of a whole table of queries, by blocks of matrix products with a running top k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query rows that go to every task as they are; beyond them blocks of queries meet blocks of rows by a shuffle.
QUERY_ROWS, QUERY_BLOCK, ROW_BLOCK, STEP = 4096, 2048, 65_536, 1024


def _fit(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _unit(column, rows: int) -> np.ndarray:
    """Rows of unit length; zero rows stay zero, so their cosine is 0."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class _Best:
    """Running k best of each query. Products only nominate; what is kept has its score from one sum a pair, so equal
    vectors have equal scores and ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, apart: bool):
        self.ids, self.q, self.k, self.apart = ids, q, k, apart
        self.kth = np.full(len(q), -np.inf)
        self.at, self.found, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(x), STEP):
            self._step(ids[a : a + STEP], x[a : a + STEP])

    def _step(self, ids: np.ndarray, x: np.ndarray) -> None:
        s = x @ self.q.T
        if self.apart:
            s[ids[:, None] == self.ids[None, :]] = -np.inf
        least = self.kth
        if len(s) > self.k:
            least = np.maximum(least, np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k])
        row, at = np.nonzero((s >= least - 1e-9) & (s > -np.inf))
        at, found, score = np.concatenate([self.at, at]), np.concatenate([self.found, ids[row]]), np.concatenate([self.score, (x[row] * self.q[at]).sum(axis=1)])
        order = np.lexsort((found, -score, at))
        at, found, score = at[order], found[order], score[order]
        start = np.searchsorted(at, np.arange(len(self.q)))
        rank = np.arange(len(at)) - start[at]
        last = rank == self.k - 1
        self.kth[at[last]] = score[last]
        keep = rank < self.k
        self.at, self.found, self.score = at[keep], found[keep], score[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.at]), pa.array(self.found), pa.array(self.score)], names=["query_id", "key", "score"])


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", apart: bool = False) -> DataFrame:
    """(query_id, key, score, rank): each query's k largest cosines, ties to the smaller key; ``apart`` leaves out the row
    whose key is the query's id.

    Tasks send k rows a query. Ids are integers, a row each; null vectors and those with null or non-finite entries take no
    part; zero vectors have cosine 0; rows of another length than the query's are no candidates.
    """
    rows = vectors.where(_fit(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.size(vector).alias("dim"))
    asked = queries.where(_fit(F.col(vector)) & F.col(query).isNotNull()).select(F.col(query).cast("long").alias("query_id"), F.col(vector).alias("v"), F.size(vector).alias("dim"))
    few = asked.limit(QUERY_ROWS + 1).toArrow()
    out = "query_id long, key long, score double"
    if few.num_rows <= QUERY_ROWS:
        groups = {int(d): few.filter(pa.compute.equal(few["dim"], d)) for d in np.unique(few["dim"].to_numpy())}
        held = {d: (t["query_id"].to_numpy(), _unit(t["v"], t.num_rows)) for d, t in groups.items()}

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, _Best] = {}
            for b in batches:
                sizes = b["dim"].to_numpy()
                for d in np.unique(sizes):
                    if int(d) in held:
                        mine = pa.array(np.flatnonzero(sizes == d))
                        best.setdefault(int(d), _Best(*held[int(d)], k, apart)).add(b["key"].take(mine).to_numpy(), _unit(b["v"].take(mine), len(mine)))
            for found in best.values():
                yield found.batch()

        parts = rows.mapInArrow(near, out)
    else:
        d_blocks, q_blocks = max(1, -(-rows.count() // ROW_BLOCK)), -(-asked.count() // QUERY_BLOCK)
        block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
        left = rows.withColumn("d", block("key", d_blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        right = asked.withColumn("q", block("query_id", q_blocks)).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1))))

        def meet(mine: pa.Table, them: pa.Table) -> pa.Table:
            if not mine.num_rows or not them.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            found = _Best(them["query_id"].to_numpy(), _unit(them["v"], them.num_rows), k, apart)
            found.add(mine["key"].to_numpy(), _unit(mine["v"], mine.num_rows))
            return pa.Table.from_batches([found.batch()])

        parts = left.groupBy("dim", "q", "d").cogroup(right.groupBy("dim", "q", "d")).applyInArrow(meet, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", "rank")
