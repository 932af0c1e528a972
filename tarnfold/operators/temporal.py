"""Recency, retention, salience, sessions, episodes, working-set and rate-limit operators.

Every operator takes its reference time as an argument; nothing reads the clock.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of short runs that a task folds as one group.
FOLDED = 10_000


def _micros(ts: Column) -> Column:
    """Of a timestamp with or without a zone (then UTC, as the session's)."""
    return F.unix_micros(ts.cast("timestamp"))


def age_seconds(ts: Column, as_of) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - _micros(ts)) / 1e6


def age_days(ts: Column, as_of) -> Column:
    """Whole days, floored."""
    return F.floor(age_seconds(ts, as_of) / 86400).cast("long")


def recency(ts: Column, as_of, decay: str, half_life_hours: float = 24.0, max_boost: float = 1.0) -> Column:
    """1 at age 0: none, linear (0 at two half lives), exponential, logarithmic, or step (1, .5, .25, 0 at h, 2h, 4h).
    Future times have the largest boost."""
    a, h = age_seconds(ts, as_of) / 3600, half_life_hours
    value = {
        "none": F.lit(1.0),
        "linear": F.greatest(F.lit(0.0), 1 - a / (2 * h)),
        "exponential": F.pow(F.lit(0.5), a / h),
        "logarithmic": 1 / (1 + F.log1p(F.greatest(a, F.lit(0.0)) / h)),
        "step": F.when(a <= h, 1.0).when(a <= 2 * h, 0.5).when(a <= 4 * h, 0.25).otherwise(0.0),
    }[decay]
    return F.when(a < 0, F.lit(max_boost)).otherwise(max_boost * value)


def hyperbolic_boost(score: Column, days: Column) -> Column:
    return score * (1 + 0.5 / (1 + days / 30))


def blended(relevance: Column, recent: Column, weight: float = 0.3) -> Column:
    return (1 - weight) * relevance + weight * recent


def retention(model: str, age_hours: Column, initial: Column, importance: Column, rehearsals: Column, accesses: Column, rate: float = 0.1) -> Column:
    """Strength left: ebbinghaus, power, exponential or act_r; the initial strength at age 0 or less; within 0 and 1."""
    lift = 0.5 + 0.5 * importance
    value = {
        "ebbinghaus": F.exp(-age_hours / (24 * (1 + 0.5 * rehearsals))) * lift * initial,
        "power": initial * F.pow(F.greatest(F.lit(1.0), age_hours), -rate / (1 + 0.3 * rehearsals)) * lift,
        "exponential": initial * F.exp(-rate / (1 + 0.5 * rehearsals) * age_hours / 24) * lift,
        "act_r": 1 / (1 + F.exp(-(F.log(F.greatest(accesses, F.lit(1))) - 0.5 * F.log(F.greatest(age_hours, F.lit(0.0)) + 1)))) * lift * initial,
    }[model]
    return F.when(age_hours <= 0, initial).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def sessions(rows: DataFrame, by: list[str], ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """Rows with a session number per key, from 1: a new one after a gap of more than ``gap_seconds``."""
    order = Window.partitionBy(*by).orderBy(ts, tie)
    gap = (_micros(F.col(ts)) - _micros(F.lag(ts).over(order))) / 1e6
    flagged = rows.withColumn("_new", F.when(gap.isNull() | (gap > gap_seconds), 1).otherwise(0))
    return flagged.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def episodes(rows: DataFrame, key: str, ts: str, item: str, gap_seconds: float = 1800, longest_seconds: float = 14400, least_items: int = 2) -> DataFrame:
    """(key, episode, first_at, last_at, items): a new episode after a gap, or once it would span more than the longest.

    A gap starts one whatever came before, so runs without a gap are independent, and a run that isn't too long is an episode:
    an aggregate. Only in longer ones does a start depend on the last one; such a run is what one task folds."""

    def fold(run: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, begin, last, n = [], None, None, 0
        for t in pdf[ts].sort_values():
            if begin is None or (t - begin).total_seconds() > longest_seconds:
                if n:
                    out.append((begin, last, n))
                begin, n = t, 0
            last, n = t, n + 1
        out.append((begin, last, n))
        kept = [e for e in out if e[2] >= least_items]
        return pd.DataFrame({key: [run[0]] * len(kept), "first_at": pd.to_datetime([e[0] for e in kept]), "last_at": pd.to_datetime([e[1] for e in kept]), "items": [e[2] for e in kept]})

    kind = dict(rows.dtypes)[key]
    runs = sessions(rows.select(key, ts, item), [key], ts, item, gap_seconds).select(key, "session", ts)
    spans = runs.groupBy(key, "session").agg(F.min(ts).cast("timestamp").alias("first_at"), F.max(ts).cast("timestamp").alias("last_at"), F.count("*").cast("int").alias("items"))
    long = (_micros(F.col("last_at")) - _micros(F.col("first_at"))) / 1e6 > longest_seconds
    whole = spans.where(~long & (F.col("items") >= least_items)).drop("session")
    cut_up = runs.join(spans.where(long).select(key, "session"), [key, "session"], "left_semi").groupBy(key, "session")
    found = whole.unionByName(cut_up.applyInPandas(fold, f"{key} {kind}, first_at timestamp, last_at timestamp, items int"))
    return found.select(key, F.row_number().over(Window.partitionBy(key).orderBy("first_at")).alias("episode"), "first_at", "last_at", "items")


def attention(rows: DataFrame, by: list[str], activation: Column, priority: Column, focused: Column) -> DataFrame:
    """Share of activation * priority in the key, doubled for focused items."""
    weight = activation * priority * F.when(focused, 2.0).otherwise(1.0)
    total = F.sum(weight).over(Window.partitionBy(*by))
    return rows.withColumn("attention", F.when(total > 0, weight / total).otherwise(0.0))


def displaced(rows: DataFrame, by: list[str], capacity: int, tie: str, activation: Column, priority: Column, idle_seconds: Column) -> DataFrame:
    """Rows beyond a key's capacity, weakest first: .4 priority + .3 activation + .3 / (1 + idle)."""
    value = 0.4 * priority + 0.3 * activation + 0.3 / (1 + idle_seconds)
    best = Window.partitionBy(*by).orderBy(F.desc("strength"), tie)
    return rows.withColumn("strength", value).withColumn("_n", F.row_number().over(best)).where(F.col("_n") > capacity).drop("_n")


def rate_limited(rows: DataFrame, key: str, ts: str, item: str, limit: int, window_seconds: float) -> DataFrame:
    """(key, item, allowed): a client's window starts anew at its first request after the last one ended. A pause of a whole
    window starts one whatever came before, so a task folds only what lies between two pauses."""

    window = round(window_seconds * 1e6)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_run", "_t", item])
        begin, n, out, last = 0, 0, [], None
        for run, t in zip(pdf["_run"].tolist(), pdf["_t"].tolist()):
            if run != last or t - begin >= window:
                begin, n, last = t, 0, run
            n += 1
            out.append(n <= limit)
        return pd.DataFrame({key: pdf[key], item: pdf[item], "allowed": out})

    kinds = dict(rows.dtypes)
    runs = sessions(rows.select(key, ts, item), [key], ts, item, window_seconds - 5e-7)
    # a run is no group of its own, as each group has its cost: runs share buckets of about FOLDED rows
    runs = runs.select(key, item, _micros(F.col(ts)).alias("_t"), F.struct(key, "session").alias("_r"))
    buckets = max(1, rows.count() // FOLDED)
    runs = runs.withColumn("_bucket", F.pmod(F.xxhash64("_r"), F.lit(buckets))).withColumn("_run", F.xxhash64(F.lit(1), "_r")).drop("_r")
    return runs.groupBy("_bucket").applyInPandas(fold, f"{key} {kinds[key]}, {item} {kinds[item]}, allowed boolean")


def episode_importance(value: Column) -> Column:
    """Aggregate: sum of cubes over sum of squares."""
    return F.sum(value * value * value) / F.sum(value * value)
