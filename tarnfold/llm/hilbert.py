"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected and shifted several times, each time ordered along a Hilbert curve and range-partitioned in
Spark. A query looks at a window of neighbouring keys on each curve; windows merge, and candidates are reranked by the
exact cosine. The window's half width is fitted: on a bounded sample of queries, searched exactly against all rows, it
is the rank distance within which the target share of true neighbours lies on at least one curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.llm.vectors import best, matrix, usable
from tarnfold.session import cut

CURVES, DIMS, BITS = 4, 6, 9
BLOCK, QUERY_GROUP = 2048, 4096
SAMPLE = 128
TARGET = 0.96


def hilbert_keys(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits an axis, by Skilling's transform."""
    x = [axes[:, i].astype(np.uint64) for i in range(axes.shape[1])]
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= one
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros(len(axes), np.uint64), one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    key = np.zeros(len(axes), np.uint64)
    x = [v ^ t for v in x]
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | ((v >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(unit: np.ndarray, curves: int, dims: int = DIMS, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """curves x rows: each curve has its own projection and shift, from the seed and the length of the vectors alone."""
    d, out = unit.shape[1], []
    for c in range(curves):
        rng = np.random.default_rng([seed, d, c])
        z = unit @ rng.standard_normal((d, dims))
        even = 1 / (1 + np.exp(-1.702 * z))  # about uniform for spread-out directions
        shifted = (even + rng.random(dims)) / 2
        out.append(hilbert_keys(np.minimum((shifted * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits))
    return np.array(out)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine_best(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the k best by exact cosine: products first sift, with room for their rounding, then each pair is
    summed alone, so that equal vectors have equal scores wherever they stand."""
    able = np.flatnonzero(ids != q_id)
    if len(able) > k:
        able = able[rough[able] >= np.partition(rough[able], len(able) - k)[len(able) - k] - 1e-9]
    y = x[able]
    score = (y * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((y * y).sum(1)))
    first = best(score, ids[able], k)
    return score[first], able[first]


FOUND = "q_row long, c_row long, query_id long, vec_id long, score double"


def _search(q: np.ndarray, q_rows: np.ndarray, q_ids: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pa.Table:
    qn, sn, at = [], [], []
    qu, xu = _unit(q), _unit(x)
    for a in range(0, len(q), 256):
        rough = qu[a : a + 256] @ xu.T
        for r, i in zip(rough, range(a, a + 256)):
            s, c = cosine_best(q[i], q_ids[i], x, ids, r, k)
            qn.append(np.full(len(s), i)), sn.append(s), at.append(c)
    join = lambda parts, kind: np.concatenate([*parts, np.empty(0)]).astype(kind)
    i, c = join(qn, np.int64), join(at, np.int64)
    return pa.table([pa.array(v) for v in (q_rows[i], rows[c], q_ids[i], ids[c], join(sn, np.float64))], names=["q_row", "c_row", "query_id", "vec_id", "score"])


def exact(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """True neighbours of a bounded list of queries, by brute force over all rows, block by block where they lie."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = np.array([i for i, _ in shared.value], np.int64), np.array([v for _, v in shared.value], np.float64)
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("v"), len(batch)).astype(np.float64)
                yield from _search(q, np.arange(len(q)), q_ids, x, batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), k).to_batches()

    parts = rows.select("row", "vec_id", "v").mapInArrow(work, FOUND)
    return _ranked(parts, k)


def _ranked(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ordered(rows: DataFrame, curves: int = CURVES) -> DataFrame:
    """(curve, pos, row, vec_id, v): every row's rank on each curve, ties of key by id.

    The range partitioning is written to the shared folder, then counted by partition; no task holds a curve."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = curve_keys(_unit(matrix(batch.column("v"), len(batch))), curves)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), c, np.int32)), pa.array(keys[c]), batch.column("row"), batch.column("vec_id"), batch.column("v")], names=["curve", "key", "row", "vec_id", "v"])

    long = rows.select("row", "vec_id", "v").mapInArrow(work, f"curve int, key long, row long, vec_id long, v {rows.schema['v'].dataType.simpleString()}")
    spread = cut(long.repartitionByRange("curve", "key", "vec_id", "row").sortWithinPartitions("curve", "key", "vec_id", "row"))
    placed = spread.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    counts = sorted(tuple(r) for r in placed.groupBy("part").count().collect())  # a row a partition
    first, table = 0, []
    for part, n in counts:
        table.append((part, first))
        first += n
    offsets = rows.sparkSession.createDataFrame(table or [(0, 0)], "part int, first long")
    return placed.join(F.broadcast(offsets), "part").select("curve", (F.col("first") + F.col("nth")).alias("pos"), "row", "vec_id", "v")


def fit_window(places: DataFrame, rows: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, target: float = TARGET) -> int:
    """Half width of the windows, in ranks. ``sample`` queries (those of the least hash) are searched exactly."""
    asked = [(r["vec_id"], [float(x) for x in r["v"]]) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    if not asked:
        return 0
    true = exact(rows, asked, k).select("query_id", "vec_id")
    true = cut(true)
    at = places.select("curve", "pos", "vec_id")
    ends = at.join(F.broadcast(true), "vec_id").select("query_id", "vec_id", "curve", F.col("pos").alias("b"))
    starts = at.join(F.broadcast(true.select(F.col("query_id").alias("vec_id")).distinct()), "vec_id").select(F.col("vec_id").alias("query_id"), "curve", F.col("pos").alias("a"))
    gaps = ends.join(starts, ["query_id", "curve"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("a") - F.col("b"))).alias("gap"))
    found = sorted(r["gap"] for r in gaps.select("gap").collect())  # sample * k numbers
    return int(found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)]) if found else 0


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, block: int = BLOCK, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Nearness is the cosine in double precision of the original vectors, ties to the smaller id, the query's own id
    aside; all candidates where there are fewer than k. Null, zero and non-finite vectors and null ids take no part; every
    row of a repeated id is a candidate, and a query under its id; vectors of different lengths do not meet; an empty table
    gives no rows; other columns are ignored. Each
    window is whole blocks of one curve; a task has one block and a bounded group of its queries and returns k rows a
    query, so no list grows with a hot vector's copies.
    """
    rows = vectors.where(usable(F.col(vector), nonzero=True)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = cut(cut(rows.where("vec_id is not null")).withColumn("row", F.monotonically_increasing_id()))
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()]
    parts = [_nearest(rows.where(F.size("v") == d) if len(lengths) > 1 else rows, every, k, curves, block, target) for d in lengths]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nearest(rows: DataFrame, every: int, k: int, curves: int, block: int, target: float) -> DataFrame:
    asked = F.col("vec_id") % every == 0
    n, m = rows.agg(F.count("*"), F.count_if(asked)).first()
    places = ordered(rows, curves)
    half = fit_window(places, rows, rows.where(asked), k, target=target)
    # blocks of a curve start at its first rank, curve * n; a query takes every block that its window touches
    rank = F.col("pos") - F.col("curve") * n
    touched = F.sequence(F.floor(F.greatest(rank - half, F.lit(0)) / block), F.floor(F.least(rank + half, F.lit(n - 1)) / block))
    per_block = m * min(1.0, (2 * half + 2 * block) / max(n, 1))
    groups = max(1, -(-int(per_block) // QUERY_GROUP))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    data = places.select("curve", F.floor(rank / block).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).alias("side"), "row", "vec_id", "v")
    query = places.where(asked).select("curve", F.explode(touched).alias("b"), group.alias("g"), F.lit(1).alias("side"), "row", "vec_id", "v")

    def work(table: pa.Table) -> pa.Table:
        side, own, ids = table["side"].to_numpy(), table["row"].to_numpy(), table["vec_id"].to_numpy()
        x = matrix(table["v"], len(side)).astype(np.float64)
        mine, data = side == 1, side == 0
        if not mine.any() or not data.any():
            return pa.table({**{c: pa.array([], pa.int64()) for c in ("q_row", "c_row", "query_id", "vec_id")}, "score": pa.array([], pa.float64())})
        return _search(x[mine], own[mine], ids[mine], x[data], own[data], ids[data], k)

    found = data.unionByName(query).groupBy("curve", "b", "g").applyInArrow(work, FOUND)
    return _ranked(found.distinct(), k)


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 50, against all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
