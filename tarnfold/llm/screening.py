"""Centroid clustering in exact integers, screened in float32.

Vectors and centroids are integers. One float32 matrix product a batch gives every distance but for the vector's own length,
within an interval that bounds all rounding: of the conversion to float32, of the products and of their sums in whatever
order. Centroids whose interval reaches below the smallest upper end are the short list. Where it has one centroid, that
is the nearest; elsewhere the listed distances are computed again in exact integers, and the lowest number wins ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.text import tidy
from tarnfold.llm.vectors import matrix, usable
from tarnfold.session import cut

LONG_MAX = 2**63 - 1
#: Half the distance from 1 to the next float32.
UNIT = 2.0**-24


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Lower and upper ends, rows x centroids, of |c|^2 - 2 x.c for integer rows. None where float32 could overflow."""
    d = x.shape[1]
    xf, cf = x.astype(np.float64), c.astype(np.float64)  # relative error 2^-53 at most
    if not len(x) or np.abs(xf).max() * np.abs(cf).max() * d > 1e37 or max(np.abs(xf).max(), np.abs(cf).max()) > 1e37:
        return None
    dot = (xf.astype(np.float32) @ cf.astype(np.float32).T).astype(np.float64)
    c2 = (cf * cf).sum(axis=1)
    over = 1 + 1e-9  # covers the float64 steps, d of some 2^-53 each
    length = np.sqrt((xf * xf).sum(axis=1)) * over
    reach = np.sqrt(c2) * over
    # x.c by d products of factors that were rounded once each, added in any order: d + 3 roundings of a summand at most
    gamma = (d + 3) * UNIT / (1 - (d + 3) * UNIT)
    error = 2 * gamma * np.outer(length, reach) + (d + 8) * 2.0**-52 * (c2 + 2 * np.abs(dot))
    middle = c2 - 2 * dot
    return middle - error * over, middle + error * over


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, paired, as exact integers: int64 where they fit, else Python's own."""
    d = x.shape[1]
    if len(x) and max(np.abs(x.astype(np.float64)).max(), np.abs(c.astype(np.float64)).max()) * 2.01 > (LONG_MAX / max(1, d)) ** 0.5:
        x, c = x.astype(object), c.astype(object)
    step = x - c
    return (step * step).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centroid, ties to the lowest."""
    ends = intervals(x, c)
    if ends is None:
        row, listed = (a.ravel() for a in np.indices((len(x), len(c))))
        out, many = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    else:
        short = ends[0] <= ends[1].min(axis=1, keepdims=True)
        out, many = short.argmax(axis=1), short.sum(axis=1) > 1
        row, listed = np.nonzero(short & many[:, None])
    if len(row):
        distance = exact(x[row], c[listed])
        order = np.lexsort((listed, distance, row)) if distance.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], distance[i], listed[i])))
        first = np.concatenate([[True], np.diff(row[order]) > 0])
        out[row[order][first]] = listed[order][first]
    return out


def whole(vectors: DataFrame, scale: int, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of vectors with ``dim`` components, none null or non-finite; beyond 64 bits
    the nearest that 64 bits hold."""
    fine = (F.size(vector) == dim) & usable(F.col(vector))
    return vectors.where(fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows of smallest sha-256 of ``seed:vec_id``, in that order; ties by the vector; rows without an id don't start."""
    hashed = rows.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["v"] for r in hashed.orderBy("hash", "v").select("v").limit(k).collect()], np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b["vec_id"], matrix(b["v"], b.num_rows)
    tidy()


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): distance beyond 64 bits is the largest that 64 bits hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches):
            best = nearest(x, centroids)
            far = np.array([min(int(v), LONG_MAX) for v in exact(x, centroids[best])], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(work, "vec_id long, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floor(sum / count) of each cluster, componentwise and exact; an empty one stays.

    A task sends a row a cluster and component, and the driver sees as many: k * dim, whatever the rows.
    """
    k, d = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, d), object)
        for _, x in _batches(batches):
            best = nearest(x, centroids)
            for j in np.unique(best):
                mine = x[best == j]
                big = np.abs(mine.astype(np.float64)).max() * len(mine) > 2.0**62
                count[j] += len(mine)
                total[j] += mine.astype(object).sum(axis=0) if big else mine.sum(axis=0).astype(object)
        some = np.flatnonzero(count)
        cols = [np.repeat(some, d).astype(np.int32), np.tile(np.arange(d), len(some)).astype(np.int32), np.repeat(count[some], d)]
        sums = pa.array([Decimal(int(v)) for v in total[some].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), sums], names=["cluster", "at", "n", "total"])

    parts = rows.mapInArrow(work, "cluster int, at int, n long, total decimal(38,0)")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of (vec_id, v array<long>) rows of one length.

    Each round reads the rows once and shuffles k * dim numbers a task; no row is shuffled. Fewer rows than k give fewer
    centroids; equal centroids are told apart by number, the lowest takes all; repeated rows come back each; rows without
    an id are clustered but don't start a cluster, and where no row has one none can; empty tables give no rows. Sums of
    distances beyond 64 bits are the largest that 64 bits hold.
    """
    centroids = start(rows, k, seed)
    if not len(centroids):
        return rows.limit(0).selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = cut(assigned(rows, centroids))
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = min(sum(sums.values()), LONG_MAX)
    digest = lambda c: hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()
    about = [(j, min(total, LONG_MAX), inertia, digest(centroids[j])) for j, total in sorted(sums.items())]
    names = found.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def op12_screened_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 fit components in 40 clusters after five rounds; other vectors, null ones too, are left out."""
    return cluster(cut(whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 256, 64)))


def oracle(k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: int = 2) -> str:
    """The same rows in SQL, a pair of common tables a round."""
    fine = f"embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {fine})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v.v, c.c, {far} AS d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY c, i)")
            steps.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    last = f"""SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"""
    return "WITH " + ",\n".join(steps) + "\n" + last
