"""Temporal queries over events."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tarnfold.operators import temporal as tm
from tarnfold.plans.registry import query, table

AS_OF = datetime.datetime(2024, 1, 31)
_AGE = "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 1e6"


def _events(spark, d):
    return table(spark, d, "events")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN '2024-01-10' AND '2024-01-12' ORDER BY ts DESC, event_id LIMIT 50")
def timeline_range(spark, d):
    return _events(spark, d).where(F.col("ts").between(datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 12))).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 10")
def timeline_page(spark, d):
    return _events(spark, d).orderBy(F.desc("ts"), "event_id").offset(10).limit(20).select("event_id")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL")
def calendar_buckets(spark, d):
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return _events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), week.alias("week"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


_REC = {
    "none": "1.0", "linear": "greatest(0, 1 - a / (2 * 72.0))", "exponential": "pow(0.5, a / 72.0)", "logarithmic": "1 / (1 + ln(1 + a / 72.0))",
    "step": "CASE WHEN a <= 72 THEN 1.0 WHEN a <= 144 THEN 0.5 WHEN a <= 288 THEN 0.25 ELSE 0 END",
}


def _recency(decay: str, expr: str):
    @query(f"SELECT event_id, round(CASE WHEN a < 0 THEN 1 ELSE {expr} END, 6) AS recency FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-25') - epoch_us(ts)) / 1e6 / 3600 AS a FROM events)", name=f"recency_{decay}")
    def run(spark, d):
        return _events(spark, d).select("event_id", F.round(tm.recency(F.col("ts"), datetime.datetime(2024, 1, 25), decay, 72.0), 6).alias("recency"))


for _d, _e in _REC.items():
    _recency(_d, _e)

_RET = {
    "ebbinghaus": "exp(-h / (24 * (1 + 0.5 * reh))) * (0.5 + 0.5 * imp) * 0.9", "power": "0.9 * pow(greatest(1, h), -0.1 / (1 + 0.3 * reh)) * (0.5 + 0.5 * imp)",
    "exponential": "0.9 * exp(-0.1 / (1 + 0.5 * reh) * h / 24) * (0.5 + 0.5 * imp)", "act_r": "1 / (1 + exp(-(ln(greatest(acc, 1)) - 0.5 * ln(greatest(h, 0) + 1)))) * (0.5 + 0.5 * imp) * 0.9",
}


def _retention(model: str, expr: str):
    sql = f"""SELECT event_id, round(r, 6) AS retention, r < 0.1 AS forgotten FROM (SELECT event_id, CASE WHEN h <= 0 THEN 0.9 ELSE least(1.0, greatest(0.0, {expr})) END AS r
    FROM (SELECT event_id, {_AGE} / 3600 AS h, user_id % 4 AS reh, user_id % 9 AS acc, (event_id % 11) / 10 AS imp FROM events))"""

    @query(sql, name=f"retention_{model}")
    def run(spark, d):
        r = tm.retention(model, tm.age_seconds(F.col("ts"), AS_OF) / 3600, F.lit(0.9), (F.col("event_id") % 11) / 10, F.col("user_id") % 4, F.col("user_id") % 9)
        return _events(spark, d).select("event_id", r.alias("r")).select("event_id", F.round("r", 6).alias("retention"), (F.col("r") < 0.1).alias("forgotten"))


for _m, _e in _RET.items():
    _retention(_m, _e)


@query(f"SELECT event_id, round((value + 0.1234567) * (1 + 0.5 / (1 + days / 30)), 6) AS boosted, round((1 - 0.3711) * value + 0.3711 * pow(0.5, {_AGE} / 3600 / 24), 6) AS blended, days FROM (SELECT *, floor({_AGE} / 86400)::BIGINT AS days FROM events)")
def recency_boosts(spark, d):
    days = tm.age_days(F.col("ts"), AS_OF)
    return _events(spark, d).select("event_id", F.round(tm.hyperbolic_boost(F.col("value") + 0.1234567, days), 6).alias("boosted"), F.round(tm.blended(F.col("value"), tm.recency(F.col("ts"), AS_OF, "exponential"), 0.3711), 6).alias("blended"), days.alias("days"))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600 * 1000000::BIGINT THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM s GROUP BY ALL""")
def sessions_gap(spark, d):
    got = tm.sessions(_events(spark, d).select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 3600)
    return got.groupBy("user_id", "session").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))


@query("""WITH RECURSIVE r AS (SELECT user_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, ts, t, n, n AS first FROM r WHERE n = 1
UNION ALL SELECT r.user_id, r.ts, r.t, r.n, CASE WHEN r.t - f.t > 1800000000 OR r.t - (SELECT b.t FROM r b WHERE b.user_id = f.user_id AND b.n = f.first) > 14400000000 THEN r.n ELSE f.first END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1),
g AS (SELECT user_id, first, min(ts) AS first_at, max(ts) AS last_at, count(*)::INT AS items FROM f GROUP BY user_id, first HAVING count(*) >= 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_at)::INT AS episode, first_at, last_at, items FROM g""")
def episodes_maxdur(spark, d):
    return tm.episodes(_events(spark, d), "user_id", "ts", "event_id")


@query("SELECT event_type, round(sum(v * v * v) / sum(v * v), 6) AS importance, arg_max(v, (abs(v - 40), event_id)) AS peak FROM (SELECT event_type, event_id, value AS v FROM events) GROUP BY event_type")
def episode_importance(spark, d):
    v = F.col("value")
    return _events(spark, d).groupBy("event_type").agg(F.round(tm.episode_importance(v), 6).alias("importance"), F.max_by(v, F.struct(F.abs(v - 40), F.col("event_id"))).alias("peak"))


@query("""WITH w AS (SELECT event_id, user_id, (event_id % 10) / 10 * ((user_id % 5) / 5) * CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS wt FROM events)
SELECT event_id, round(CASE WHEN sum(wt) OVER (PARTITION BY user_id) > 0 THEN wt / sum(wt) OVER (PARTITION BY user_id) ELSE 0 END, 6) AS attention FROM w""")
def attention_share(spark, d):
    got = tm.attention(_events(spark, d), ["user_id"], (F.col("event_id") % 10) / 10, (F.col("user_id") % 5) / 5, F.col("event_type") == "click")
    return got.select("event_id", F.round("attention", 6).alias("attention"))


@query(f"""WITH s AS (SELECT event_id, user_id, 0.4 * ((user_id % 5) / 5) + 0.3 * ((event_id % 10) / 10) + 0.3 / (1 + {_AGE}) AS strength FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, event_id) AS n FROM s) SELECT event_id, user_id, round(strength, 6) AS strength FROM r WHERE n > 7""")
def displacement_order(spark, d):
    got = tm.displaced(_events(spark, d), ["user_id"], 7, "event_id", (F.col("event_id") % 10) / 10, (F.col("user_id") % 5) / 5, tm.age_seconds(F.col("ts"), AS_OF))
    return got.select("event_id", "user_id", F.round("strength", 6).alias("strength"))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, t AS began, 1 AS k FROM r WHERE n = 1
UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN r.t - f.began >= 86400000000 THEN r.t ELSE f.began END, CASE WHEN r.t - f.began >= 86400000000 THEN 1 ELSE f.k + 1 END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, event_id, k <= 5 AS allowed FROM f""")
def rate_limiter(spark, d):
    return tm.rate_limited(_events(spark, d), "user_id", "ts", "event_id", 5, 86400)


@query(f"SELECT event_id, round(greatest(0.1, value / 100 - 0.001 * (1 - 0.5 * ((event_id % 4) / 4)) * {_AGE} / 3600), 6) AS activation FROM events")
def activation_decay(spark, d):
    e = _events(spark, d)
    return e.select("event_id", F.round(F.greatest(F.lit(0.1), F.col("value") / 100 - 0.001 * (1 - 0.5 * ((F.col("event_id") % 4) / 4)) * tm.age_seconds(F.col("ts"), AS_OF) / 3600), 6).alias("activation"))
