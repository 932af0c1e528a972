"""Stateful streams over ``events``, each with a fold of the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.plans.consolidate import _folder
from tarnfold.plans.registry import query, table
from tarnfold.streaming import jobs, stateful

_ROWS = """p AS (SELECT user_id AS key, ts, event_id AS tie, (event_id * 7 % 17)::VARCHAR AS item, (event_id * 3 % 10) / 10 AS priority FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events) - 3600000),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, tie) AS n FROM p)"""


def _changes(value: str) -> str:
    """A key's set as a list in order of what goes first; one more row a step."""
    entry = f"{{'v': {value}, 'n': r.n, 'item': r.item}}"
    has = "len(list_filter(f.held, lambda x: x.item = r.item)) > 0"
    return f"""{_ROWS}, f AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, []::STRUCT(v DOUBLE, n BIGINT, item VARCHAR)[] AS held, NULL::VARCHAR AS gone, NULL::VARCHAR AS came FROM r
UNION ALL SELECT r.key, r.n, r.ts, CASE WHEN {has} THEN f.held WHEN len(f.held) >= 7 THEN list_sort(list_append(f.held[2:], {entry})) ELSE list_sort(list_append(f.held, {entry})) END,
  CASE WHEN NOT {has} AND len(f.held) >= 7 THEN f.held[1].item END, CASE WHEN NOT {has} THEN r.item END FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)"""


def _rows(spark, d):
    e = jobs.stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    return e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), (F.col("event_id") * 7 % 17).cast("string").alias("item"), (F.col("event_id") * 3 % 10 / 10).alias("priority"))


def _run(spark, d, processor):
    out = _folder(spark, "stateful")
    stateful.run(stateful.stateful(_rows(spark, d), processor), out + "/out", out + "/progress")
    return jobs.appended(spark, out + "/out")


@query(f"WITH RECURSIVE {_changes('r.priority')} SELECT key, ts, gone AS item, came AS cause FROM f WHERE gone IS NOT NULL")
def stream_displaced(spark, d):
    """What a working set of seven a user gives up, the least important first: the displacement callback as a table."""
    return _run(spark, d, stateful.WorkingSet(7, "lowest_priority")).where("change = 'out'").select("key", "ts", "item", "cause")


@query(f"WITH RECURSIVE {_changes('r.n')}, l AS (SELECT key, max(n) AS n FROM f GROUP BY key) SELECT key, list_sort(list_transform(held, lambda x: x.item)) AS held FROM f JOIN l USING (key, n)")
def stream_working_set(spark, d):
    """What each user's set holds in the end, the oldest given up first: what came in more often than it went out."""
    changes = _run(spark, d, stateful.WorkingSet(7, "oldest"))
    net = changes.groupBy("key", "item").agg(F.sum(F.when(F.col("change") == "in", 1).otherwise(-1)).alias("net")).where("net > 0")
    return net.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("held"))  # seven a key


@query(f"""WITH RECURSIVE {_ROWS}, f AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, NULL::BIGINT AS tie, NULL::BIGINT AS began, 0 AS granted, false AS allowed FROM r
UNION ALL SELECT r.key, r.n, r.ts, r.tie, CASE WHEN f.began IS NULL OR epoch_us(r.ts) - f.began >= 86400000000 THEN epoch_us(r.ts) ELSE f.began END,
  CASE WHEN f.began IS NULL OR epoch_us(r.ts) - f.began >= 86400000000 THEN 1 WHEN f.granted < 3 THEN f.granted + 1 ELSE f.granted END,
  f.began IS NULL OR epoch_us(r.ts) - f.began >= 86400000000 OR f.granted < 3 FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, ts, tie, allowed, (3 - granted)::INT AS remaining, make_timestamp(began + 86400000000) AS ends FROM f WHERE n > 0""")
def stream_rate_limits(spark, d):
    """Three requests a user and day that begins with a request."""
    return _run(spark, d, stateful.RateWindows(3, 86400))
