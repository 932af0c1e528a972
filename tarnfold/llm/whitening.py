"""Whitening of embeddings by TSQR.

Entries become integers, so sums are exact and rows are centred on them without drift. Each partition of the distinct rows is
brought to a triangular factor R by QR, batch on batch; factors merge in a tree, a few at a time; the SVD of the last
one gives components (right vectors) and standard deviations. The covariance is never formed, so no eigenvalue loses half
of its digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.text import tidy
from tarnfold.llm.vectors import matrix, usable
from tarnfold.session import cut

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Factors that one step of the tree merges, and lengths of vectors in one table.
FAN, LENGTHS = 16, 256
LARGEST = 2.0**62
LONG_MAX = 2**63 - 1


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): x holds floor(64 c) + 1000000 of each entry c as little-endian integers, of 32 bits where all of a
    row's fit, else of 64, so equal rows have equal bytes. Entries beyond 2^62 are held at 2^62. Vectors that are null,
    empty or hold a null or non-finite entry go; null and repeated ids stay; other columns are ignored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["dim"].to_numpy()
            packed: list[bytes] = [b""] * len(sizes)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                c = matrix(b["v"].take(pa.array(at)), len(at)).astype(np.float64)
                x = np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT
                small = (np.abs(x) < 2**31).all(axis=1)
                for i, row, narrow in zip(at, x, small):
                    packed[i] = row.astype("<i4" if narrow else "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["dim"], pa.array(packed, pa.binary())], names=["vec_id", "dim", "x"])
        tidy()

    fine = vectors.where(usable(F.col(vector)) & (F.size(vector) > 0))
    return fine.select(F.col(key).cast("long").alias("vec_id"), F.size(vector).alias("dim"), F.col(vector).alias("v")).mapInArrow(work, "vec_id long, dim int, x binary")


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in a batch: the length, which rows have it, and the rows as 64-bit integers."""
    sizes = b["dim"].to_numpy()
    x = b["x"]
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        raw = x.take(pa.array(at)).to_pylist()
        out = np.empty((len(at), d), np.int64)
        narrow = np.array([len(r) == 4 * d for r in raw])
        for mask, kind in ((narrow, "<i4"), (~narrow, "<i8")):
            if mask.any():
                out[mask] = np.frombuffer(b"".join(r for r, m in zip(raw, mask) if m), kind).reshape(-1, d)
        yield int(d), at, out


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and exact sums of each length: a row a task, length and dimension is aggregated, one a length and dimension comes
    to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for d, _, x in _rows(b):
                big = np.abs(x.astype(np.float64)).max() * len(x) > LARGEST
                s = x.astype(object).sum(axis=0) if big else x.sum(axis=0).astype(object)
                t = total.setdefault(d, [0, np.zeros(d, object)])
                t[0], t[1] = t[0] + len(x), t[1] + s
        for d, (n, s) in total.items():
            cols = [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cols, names=["dim", "at", "n", "total"])

    parts = fit.mapInArrow(work, "dim int, at int, n long, total decimal(38,0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.collect():
        out.setdefault(r["dim"], (r["n"], [0] * r["dim"]))[1][r["at"]] = int(r["total"])
    return out


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S exactly: int64 where it fits, else Python's integers."""
    s = np.array(sums, object)
    if np.abs(x.astype(np.float64)).max() * n < LARGEST and max(abs(v) for v in sums) < LARGEST:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def _tree(parts: DataFrame, merge: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Merges (dim, part, payload) rows in groups of FAN, level on level, until each length has one; these come to the driver."""

    def work(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, part, out = key[0].as_py(), key[1].as_py(), None
        for b in rows:
            for p in b["payload"]:
                mine = np.frombuffer(p.as_buffer(), np.float64)
                out = mine if out is None else merge(d, out, mine)
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["dim", "part", "payload"])

    parts = cut(parts)
    last = parts.agg(F.max("part")).first()[0]
    while last:
        last //= FAN
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("dim", "part").applyInArrow(work, "dim int, part int, payload binary")
    return {r["dim"]: np.frombuffer(bytes(r["payload"]), np.float64) for r in parts.collect()}


def _factor(rows: np.ndarray, d: int) -> np.ndarray:
    """R of a QR, padded to d x d."""
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, d))
    return np.vstack([r, np.zeros((d - len(r), d))])


def _folded(fit: DataFrame, step: Callable[[int, np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """(dim, part, payload): a partition's rows folded batch on batch, a payload a length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _rows(b):
                held[d] = step(d, held.get(d), x)
        part = TaskContext.get().partitionId()
        cols = [pa.array(list(held), pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["dim", "part", "payload"])
        tidy()

    return fit.mapInArrow(work, "dim int, part int, payload binary")


@dataclass
class Model:
    """Of one length: rows and sums of the fit list, components as columns of unit length, eigenvalues and their trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def white(self, x: np.ndarray) -> np.ndarray:
        return ((_scaled(x, self.n, self.sums) / self.n).astype(np.float64) @ self.vectors) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n*x - S)^2, exact; beyond 64 bits the largest that 64 bits hold."""
        y = _scaled(x, self.n, self.sums)
        f = y.astype(np.float64)
        about = (f * f).sum(axis=1)
        with np.errstate(over="ignore"):
            out = (y * y).sum(axis=1) if y.dtype != object else np.zeros(len(x), np.int64)  # right where below 2^63
        out[about > 9.3e18] = LONG_MAX
        for i in np.flatnonzero((about <= 9.3e18) & ((about > 9.1e18) | (y.dtype == object))):
            out[i] = min(sum(int(v) ** 2 for v in y[i]), LONG_MAX)
        return out.astype(np.int64)


def _moments(w: np.ndarray) -> np.ndarray:
    """Count, means and centred products of rows, flat."""
    m = w.mean(axis=0)
    return np.concatenate([[float(len(w))], m, ((w - m).T @ (w - m)).ravel()])


def _joined(a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """Moments of both lots of rows."""
    n, step = a[0] + b[0], b[1 : r + 1] - a[1 : r + 1]
    m = a[1 : r + 1] + step * (b[0] / n)
    products = a[r + 1 :] + b[r + 1 :] + np.outer(step, step).ravel() * (a[0] * b[0] / n)
    return np.concatenate([[n], m, products])


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Models by length of (dim, x) rows, each distinct x counted once.

    The driver sees a length's sums, one d x d factor and a small matrix. A component whose eigenvalue is nothing but
    rounding can't be whitened and is left out, so fewer distinct rows give fewer components, and one row gives none.
    """
    distinct = cut(rows.select("dim", "x").distinct())
    sums = _sums(distinct)
    if len(sums) > LENGTHS:
        raise ValueError(f"vectors of {len(sums)} lengths; at most {LENGTHS} in one table")

    def factor(d: int, r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        n, s = sums[d]
        y = (_scaled(x, n, s) / n).astype(np.float64)
        return _factor(y if r is None else np.vstack([r.reshape(d, d), y]), d).ravel()

    factors = _tree(_folded(distinct, factor), lambda d, a, b: _factor(np.vstack([a.reshape(d, d), b.reshape(d, d)]), d).ravel())
    models = {}
    for d, r in factors.items():
        n, s = sums[d]
        _, deviations, right = np.linalg.svd(r.reshape(d, d))
        real = int((deviations > deviations[0] * d * 2.0**-50).sum()) if deviations[0] > 0 else 0
        keep = min(components, real)
        values = deviations**2 / n
        models[d] = Model(n, s, right[:keep].T.copy(), values[:keep], float(values.sum()))
    some = {d: m for d, m in models.items() if len(m.values)}

    def moments(d: int, held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        if d not in some:
            return np.zeros(1)
        mine = _moments(some[d].white(x))
        return mine if held is None else _joined(held, mine, len(some[d].values))

    for d, got in _tree(_folded(distinct, moments), lambda d, a, b: _joined(a, b, len(some[d].values)) if d in some else a).items():
        if d in some:
            r = len(some[d].values)
            some[d].error = float(np.abs(got[r + 1 :].reshape(r, r) / got[0] - np.eye(r)).max())
    return models


def whitened(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row and component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in _rows(b):
                m = models[d]
                r = len(m.values)
                if not r:
                    continue
                ids, w = b["vec_id"].take(pa.array(np.repeat(at, r))), m.white(x)
                shape = (len(at), r)
                of = lambda row: pa.array(np.broadcast_to(row, shape).ravel())
                cols = [ids, of(np.arange(1, r + 1, dtype=np.int32)), of(np.int64(m.n)), of(m.deviation(x)[:, None]), pa.array(w.ravel()), of(m.values / m.trace), of(m.error)]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        tidy()

    return rows.mapInArrow(work, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the first 16 components of the table's distinct vectors.

    Vectors of another length have a model of their own; repeated rows and ids come back each; ties of eigenvalues leave
    the choice of components inside their space open, as SVD gives it; an empty table gives no rows.
    """
    rows = cut(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return whitened(rows, fit(rows))
