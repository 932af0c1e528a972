"""Remote events applied in causal order, and two-way sync, over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.operators import sync
from tarnfold.plans.registry import query, table

# Nodes are event types. A node sees the others once a day, at midnight; a few late events never arrive.
_LOST = "(event_id % 1000 = 900 AND q.day >= DATE '2024-01-20')"
_LOG = f"""d AS (SELECT *, ts::DATE AS day FROM events), c AS (SELECT event_type AS node, day, count(*) AS n FROM d GROUP BY ALL),
days AS (SELECT DISTINCT day FROM d), b AS (SELECT days.day, n.node, coalesce(sum(c.n), 0)::BIGINT AS before FROM days CROSS JOIN (SELECT DISTINCT node FROM c) n LEFT JOIN c ON c.node = n.node AND c.day < days.day GROUP BY ALL),
q AS (SELECT d.*, event_type AS node, before + row_number() OVER (PARTITION BY event_type, d.day ORDER BY ts, event_id) AS seq FROM d JOIN b ON b.day = d.day AND b.node = event_type),
x AS MATERIALIZED (SELECT q.node, q.seq, b.node AS other, CASE WHEN b.node = q.node THEN q.seq ELSE b.before END AS count FROM q JOIN b ON b.day = q.day WHERE NOT {_LOST}),
r AS MATERIALIZED (SELECT user_id AS key, node, seq, event_id, ts, value FROM q WHERE NOT {_LOST}),
p0 AS (SELECT node, coalesce(min(rn) FILTER (seq <> rn), max(rn) + 1) - 1 AS upto FROM (SELECT node, seq, row_number() OVER (PARTITION BY node ORDER BY seq) AS rn FROM r) GROUP BY node)"""


def _round(i: int) -> str:
    return f"p{i + 1} AS (SELECT p.node, least(p.upto, coalesce(e.most, p.upto)) AS upto FROM p{i} p LEFT JOIN (SELECT x.node, min(x.seq) - 1 AS most FROM x JOIN p{i} l ON l.node = x.other WHERE x.other <> x.node AND x.count > l.upto GROUP BY x.node) e ON e.node = p.node)"


_ROUNDS = ", ".join(_round(i) for i in range(8))


def _log(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("node", F.col("event_type"))
    per = e.groupBy("node", "day").agg(F.count("*").alias("n"))
    days = per.select("day").distinct().join(F.broadcast(per.select("node").distinct()))  # a row a day and node
    sofar = Window.partitionBy("node").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.join(per, ["node", "day"], "left").withColumn("before", F.coalesce(F.sum("n").over(sofar), F.lit(0)))
    clocks = before.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("node", "before"))).alias("seen"))
    nth = F.row_number().over(Window.partitionBy("node", "day").orderBy("ts", "event_id"))
    rows = e.withColumn("nth", nth).join(F.broadcast(clocks), "day").withColumn("seq", F.col("seen")[F.col("node")] + F.col("nth"))
    own = F.map_concat(F.map_filter("seen", lambda n, c: n != F.col("node")), F.map_from_arrays(F.array("node"), F.array("seq")))
    kept = rows.where(~((F.col("event_id") % 1000 == 900) & (F.col("day") >= F.lit("2024-01-20").cast("date"))))
    stamped = F.col("ts").cast("timestamp")
    return kept.select(
        F.col("user_id").alias("key"), "node", "seq", own.alias("clock"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("content"), (F.col("value") / 100).alias("confidence"),
        F.array(F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))).alias("tags"), (F.col("event_id") % 11).cast("int").alias("version"), stamped.alias("created_at"), stamped.alias("updated_at"), "event_id",
    )


def _local(spark, d) -> DataFrame:
    """A row of our own for every third user, made when two nodes' first hundred events had been seen."""
    keys = table(spark, d, "events").where("user_id % 3 = 0").select(F.col("user_id").alias("key")).distinct()
    clock = F.create_map(F.lit("local"), F.lit(1).cast("long"), F.lit("click"), F.lit(100).cast("long"), F.lit("view"), F.lit(100).cast("long"))
    at = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return keys.select("key", F.lit("local").alias("node"), F.lit(1).cast("long").alias("seq"), clock.alias("clock"), F.lit("c1").alias("content"), F.lit(0.5).alias("confidence"), F.array(F.lit("own")).alias("tags"), F.lit(7).alias("version"), at.alias("created_at"), at.alias("updated_at"))


_STATE = f"""WITH {_LOG}, {_ROUNDS},
a AS (SELECT r.key, r.node, r.seq, 'c' || event_id % 3 AS content, value / 100 AS confidence, ['t' || event_id % 5] AS tags, (event_id % 11)::INT AS version, ts AS created_at, ts AS updated_at FROM r JOIN p8 p ON p.node = r.node AND r.seq <= p.upto
  UNION ALL SELECT DISTINCT user_id, 'local', 1, 'c1', 0.5, ['own'], 7, TIMESTAMP '2024-01-15 12:00:00', TIMESTAMP '2024-01-15 12:00:00' FROM events WHERE user_id % 3 = 0),
k AS MATERIALIZED (SELECT a.key, x.node, x.other, x.count FROM a JOIN x USING (node, seq) UNION ALL SELECT key, 'local', u.o, u.n FROM a, (VALUES ('local', 1), ('click', 100), ('view', 100)) u(o, n) WHERE a.node = 'local'),
f AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.key = a.key AND k.other = a.node AND (CASE WHEN k.node = a.node THEN k.count > a.seq ELSE k.count >= a.seq END))),
g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ORDERED, updated_at DESC, node) AS rk FROM f),
z AS (SELECT key, arg_min(node, rk) AS node, arg_min(content, rk) AS content, arg_min(confidence, rk) AS confidence, arg_min(tags, rk) AS tags, arg_min(version, rk) AS version, arg_min(created_at, rk) AS created_at, arg_min(updated_at, rk) AS updated_at,
  count(*)::INT AS candidates, min(content) = max(content) AND MERGES AND count(*) > 1 AS m, list_sort(list_distinct(flatten(list(tags)))) AS united, max(confidence) AS mc, max(version) AS mv, min(created_at) AS mn FROM g GROUP BY key),
h AS (SELECT key, sum(c)::BIGINT AS clock_total FROM (SELECT key, other, max(count) AS c FROM k GROUP BY key, other) GROUP BY key)
SELECT key, content, round(CASE WHEN m THEN mc ELSE confidence END, 6) AS confidence, CASE WHEN m THEN united ELSE tags END AS tags, (CASE WHEN m THEN mv + 1 ELSE version END)::INT AS version, CASE WHEN m THEN mn ELSE created_at END AS created_at, updated_at,
  CASE WHEN m THEN 'merged' WHEN OPEN AND candidates > 1 THEN 'open' ELSE node END AS winner, candidates, clock_total FROM z JOIN h USING (key)"""


def _applied(policy: str, ordered: str):
    sql = _STATE.replace("ORDERED", ordered).replace("MERGES", str(policy == "merge").lower()).replace("OPEN", str(policy == "manual").lower())

    @query(sql, name=f"apply_remote_events_{policy}")
    def run(spark, d):
        """Events of five nodes with a few lost ones: prefixes that may be delivered, then each user's undominated events."""
        state, _, _ = sync.apply_remote_events(_local(spark, d), _log(spark, d), spark.createDataFrame([], "node string, upto long"), policy)
        total = F.aggregate(F.map_values("clock"), F.lit(0).cast("long"), lambda s, c: s + c)
        return state.select("key", "content", F.round("confidence", 6).alias("confidence"), "tags", "version", "created_at", "updated_at", "winner", "candidates", total.alias("clock_total"))


_applied("lww", "1")
_applied("fww", "created_at")
_applied("version", "version DESC")
_applied("merge", "1")
_applied("ours", "node <> 'local'")
_applied("theirs", "node = 'local'")
_applied("manual", "node <> 'local'")


@query(f"WITH {_LOG}, {_ROUNDS} SELECT r.node, count(*) AS held_back, min(r.seq) AS first_seq, any_value(p.upto) AS upto FROM r JOIN p8 p ON p.node = r.node AND r.seq > p.upto GROUP BY r.node")
def events_held_back(spark, d):
    _, held, upto = sync.apply_remote_events(_local(spark, d), _log(spark, d), spark.createDataFrame([], "node string, upto long"))
    return held.join(upto, "node").groupBy("node").agg(F.count("*").alias("held_back"), F.min("seq").alias("first_seq"), F.first("upto").alias("upto"))


_SIDES = """a AS (SELECT o_orderkey AS key, 'c' || o_orderkey % 5 AS content, 0.5 AS confidence, ['x', 'l' || o_orderkey % 2] AS tags, 'a' || o_orderkey % 2 AS agent, (o_orderkey % 3)::INT AS version, o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP + to_days((o_orderkey % 7)::INT) AS updated_at FROM orders WHERE o_orderkey % 4 <> 0),
b AS (SELECT o_orderkey AS key, 'c' || o_custkey % 5 AS content, o_orderkey % 10 / 10 AS confidence, ['x', 'r'] AS tags, 'a' || o_custkey % 2 AS agent, (o_custkey % 3)::INT AS version, o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP + to_days((o_custkey % 7)::INT) AS updated_at FROM orders WHERE o_orderkey % 5 <> 0)"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    def side(rows, k, confidence, tags, clock):
        date = F.col("o_orderdate").cast("timestamp")
        made = [F.col("o_orderkey").alias("key"), F.concat(F.lit("c"), (F.col(k) % 5).cast("string")).alias("content"), confidence.cast("double").alias("confidence"), tags.alias("tags"), F.concat(F.lit("a"), (F.col(k) % 2).cast("string")).alias("agent")]
        return rows.select(*made, (F.col(k) % 3).cast("int").alias("version"), date.alias("created_at"), (date + F.make_dt_interval(days=(F.col(k) % 7).cast("int"))).alias("updated_at"), clock.alias("clock"))

    o = table(spark, d, "orders")
    clock = lambda n: F.create_map(F.lit("local"), F.lit(n).cast("long"), F.lit("far"), (F.col("o_orderkey") % 4).cast("long"))
    local = side(o.where("o_orderkey % 4 <> 0"), "o_orderkey", F.lit(0.5), F.array(F.lit("x"), F.concat(F.lit("l"), (F.col("o_orderkey") % 2).cast("string"))), clock(2))
    return local, side(o.where("o_orderkey % 5 <> 0"), "o_custkey", F.col("o_orderkey") % 10 / 10, F.array(F.lit("x"), F.lit("r")), clock(1))


def _synced(policy: str, resolved: str):
    sql = f"""WITH {_SIDES}, j AS (SELECT coalesce(a.key, b.key) AS key, a, b, CASE WHEN a.key IS NULL THEN 'inserted' WHEN b.key IS NULL THEN 'kept' WHEN a.version <> b.version AND a.agent <> b.agent THEN {resolved} WHEN b.version > a.version THEN 'taken' ELSE 'kept' END AS action FROM a FULL JOIN b ON a.key = b.key),
p AS (SELECT key, action, b.key IS NULL AS lacks, b.version AS known, CASE WHEN action IN ('inserted', 'taken', 'remote') THEN b ELSE a END AS s, CASE WHEN action = 'merged' THEN greatest(a.version, b.version) + 1 END AS mv, greatest(a.confidence, b.confidence) AS mc, list_sort(list_distinct(list_concat(a.tags, b.tags))) AS mt FROM j),
v AS (SELECT *, coalesce(mv, s.version) AS version FROM p)
SELECT key, s.content AS content, round(CASE WHEN mv IS NULL THEN s.confidence ELSE mc END, 6) AS confidence, list_sort(CASE WHEN mv IS NULL THEN s.tags ELSE mt END) AS tags, CASE WHEN mv IS NULL THEN s.agent ELSE 'local' END AS agent, version::INT AS version, action,
  (lacks OR version > known) AND NOT ({'EXISTS (SELECT 1 FROM v WHERE action = ' + chr(39) + 'conflict' + chr(39) + ')' if policy == 'manual' else 'false'}) AS pushed FROM v"""

    @query(sql, name=f"two_way_sync_{policy}")
    def run(spark, d):
        out = sync.two_way_sync(*_sides(spark, d), policy)
        return out.select("key", "content", F.round("confidence", 6).alias("confidence"), F.array_sort("tags").alias("tags"), "agent", "version", "action", "pushed")


_synced("latest", "CASE WHEN b.updated_at > a.updated_at THEN 'remote' ELSE 'local' END")
_synced("ours", "'local'")
_synced("theirs", "'remote'")
_synced("merge", "CASE WHEN a.content = b.content THEN 'merged' ELSE 'conflict' END")
_synced("manual", "'conflict'")
