"""Score calibration fitted where the scores are: Platt scaling by sums, isotonic regression by pooling in a tree, min-max."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.session import cut

#: Parts that one step of the tree pools, and bins of a score's range in which intervals are looked up.
FAN, BINS = 16, 1024


def _counted(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(s, n, y): rows and sum of labels of each score; null or non-finite scores and null labels take no part."""
    s = F.col(score).cast("double")
    rows = scored.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & F.col(label).isNotNull())
    return rows.groupBy(s.alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("y"))


def fit_platt(scored: DataFrame, score: str = "score", label: str = "label", method: str = "newton", steps: int = 50, rate: float = 0.1) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-a s - b)), from a = 1, b = 0. Equal scores are counted once for all steps; a step is one
    aggregate of seven sums, and the driver sees these.

    newton: second-order steps, halved where one made the likelihood worse, until a and b move by less than 1e-10, ``steps``
    at most (labels that a score separates have no best a; it is what the last step made it). gradient: ``steps`` plain steps
    of ``rate`` on the mean gradient. No rows: (1, 0).
    """
    rows, a, b = cut(_counted(scored, score, label)), 1.0, 0.0
    least, at = math.inf, (a, b)
    for _ in range(steps):
        z = a * F.col("s") + b
        p = 1 / (1 + F.exp(-z))
        e, w = F.col("n") * p - F.col("y"), F.col("n") * p * (1 - p)
        loss = F.col("n") * (F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))) - F.col("y") * z
        n, cost, ga, gb, aa, ab, bb = rows.agg(F.sum("n"), F.sum(loss), F.sum(e * F.col("s")), F.sum(e), F.sum(w * F.col("s") * F.col("s")), F.sum(w * F.col("s")), F.sum(w)).first()
        if not n:
            return 1.0, 0.0
        if method == "gradient":
            a, b = a - rate * ga / n, b - rate * gb / n
            continue
        if cost > least + 1e-12 * abs(least):
            a, b = (a + at[0]) / 2, (b + at[1]) / 2
            if max(abs(a - at[0]), abs(b - at[1])) < 1e-10:
                return at
            continue
        least, at = cost, (a, b)
        det = aa * bb - ab * ab
        if det > 1e-12 * max(aa * bb, 1e-300):
            da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        elif bb > 1e-12:  # one score only
            da, db = 0.0, gb / bb
        else:
            break
        if max(abs(da), abs(db)) < 1e-10:
            break
        a, b = a - da, b - db
    return a, b


def fit_minmax(scored: DataFrame, score: str = "score") -> tuple[float, float] | None:
    low, high = scored.agg(F.min(score), F.max(score)).first()
    return None if low is None else (float(low), float(high))


def minmax(score: Column, fitted: tuple[float, float] | None) -> Column:
    """Equal ends: 0.5."""
    return F.lit(0.5) if fitted is None or fitted[0] == fitted[1] else (score - fitted[0]) / (fitted[1] - fitted[0])


def pool(low: np.ndarray, high: np.ndarray, n: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Adjacent blocks in order of score, pooled until means rise strictly."""
    keep: list[list[float]] = []
    for block in zip(low, high, n, y):
        now = list(block)
        while keep and keep[-1][3] * now[2] >= now[3] * keep[-1][2]:
            last = keep.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        keep.append(now)
    return [np.array(c) for c in zip(*keep)] if keep else [np.empty(0)] * 4


_BLOCK = "low double, high double, n double, y double, part int"


def _batch(blocks: list[np.ndarray], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in blocks), pa.array(np.full(len(blocks[0]), part), pa.int32())], names=["low", "high", "n", "y", "part"])


def fit_isotonic(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(low, high, value, n): blocks of scores in rising order with rising means, the least-squares monotone fit.

    Scores are range-partitioned and pooled a part each; neighbouring parts pool what is left in a tree. Blocks of 0/1 labels
    are at most some n^(2/3), as their means are different fractions of sizes that sum to n; that is what the last step holds.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [np.empty(0)] * 4, 0
        for b in batches:
            if b.num_rows:
                s, n, y = (b[c].to_numpy(zero_copy_only=False).astype(float) for c in ("s", "n", "y"))
                part = b["part"][0].as_py()
                held = pool(*[np.concatenate([h, x]) for h, x in zip(held, (s, s, n, y))])
        if len(held[0]):
            yield _batch(held, part)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        return pa.Table.from_batches([_batch(pool(*[table[c].to_numpy() for c in ("low", "high", "n", "y")]), key[0].as_py())])

    ranged = _counted(scored, score, label).repartitionByRange("s").sortWithinPartitions("s").withColumn("part", F.spark_partition_id())
    blocks = cut(ranged.mapInArrow(first, _BLOCK))
    last = blocks.agg(F.max("part")).first()[0] or 0
    while last:
        last //= FAN
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(merge, _BLOCK)
    return blocks.select("low", "high", (F.col("y") / F.col("n")).alias("value"), F.col("n").cast("long").alias("n"))


def isotonic(rows: DataFrame, blocks: DataFrame, score: str = "score", into: str = "calibrated") -> DataFrame:
    """``rows`` with the fit at their score: a block's value inside it, linear between blocks, the end values beyond; null
    without a score or a fit.

    Intervals are looked up by bins of the score's range, an equi-join in which a row meets the intervals of its bin.
    """
    kind = "x0 double, x1 double, y0 double, y1 double"

    def steps(table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        low, high, value = (table[c].to_numpy() for c in ("low", "high", "value"))
        x = np.column_stack([low, high]).ravel()
        y = np.repeat(value, 2)
        return pa.table({"x0": np.concatenate([[-np.inf], x]), "x1": np.concatenate([x, [np.inf]]), "y0": np.concatenate([y[:1], y]), "y1": np.concatenate([y, y[-1:]])})

    fitted = cut(blocks)
    low, high, many = fitted.agg(F.min("low"), F.max("high"), F.count("*")).first()
    if not many:
        return rows.withColumn(into, F.lit(None).cast("double"))
    width = max((high - low) / BINS, 1e-300)
    cell = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(float(BINS)), F.floor((x - low) / width))).cast("int")
    intervals = fitted.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: steps(t), kind)
    # a score at an edge belongs to the interval that begins there, so intervals of no width are left out
    intervals = intervals.where("x1 > x0").withColumn("_bin", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))))
    intervals = F.broadcast(intervals) if many <= 100_000 else intervals
    s = F.col(score).cast("double")
    numbered = rows.withColumn("_bin", cell(s)).withColumn("_s", s)
    met = numbered.join(intervals, (numbered["_bin"] == intervals["_bin"]) & (F.col("_s") >= F.col("x0")) & (F.col("_s") < F.col("x1")), "left")
    value = F.when(F.col("y0") == F.col("y1"), F.col("y0")).otherwise(F.col("y0") + (F.col("_s") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    return met.select(*[rows[c] for c in rows.columns], value.alias(into))
