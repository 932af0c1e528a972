"""Versioned rows from orders, branches and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import versioning as vs
from tarnfold.plans.registry import query, table

_LOG = "log AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderpriority AS content, o_orderstatus AS branch, o_totalprice AS price, o_orderdate AS created_at, o_orderkey % 9 = 0 AS is_deleted FROM orders)"


def _log(spark, d):
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("content"), F.col("o_orderstatus").alias("branch"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 9 == 0).alias("is_deleted"), "o_orderkey")
    return vs.numbered(log, "id", "created_at", "o_orderkey").drop("o_orderkey").withColumn("version", F.col("version").cast("long"))


@query(f"WITH {_LOG} SELECT id, version, content, is_deleted FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def latest_version(spark, d):
    return vs.latest(_log(spark, d), ["id"]).select("id", "version", "content", "is_deleted")


@query(f"WITH {_LOG} SELECT id, version FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) WHERE NOT is_deleted")
def commit_snapshot(spark, d):
    return vs.snapshot(vs.latest(_log(spark, d), ["id"]))


@query(f"WITH {_LOG} SELECT version, content, price FROM log WHERE id = 4 ORDER BY version DESC LIMIT 3")
def version_history(spark, d):
    return vs.history(_log(spark, d), "id", 4, 3).select("version", "content", "price")


@query(f"WITH {_LOG} SELECT log.id, log.version, log.content FROM log JOIN (SELECT id, max(version) AS v FROM log WHERE created_at < '1996-01-01' GROUP BY id) w ON log.id = w.id AND log.version = w.v")
def as_of_version(spark, d):
    log = _log(spark, d)
    return vs.as_of_version(log, log.where("created_at < '1996-01-01'").groupBy("id").agg(F.max("version").alias("version"))).select("id", "version", "content")


@query(f"""WITH {_LOG}, now AS (SELECT id, max(version) AS v FROM log GROUP BY id), old AS (SELECT id, max(version) AS v FROM log WHERE created_at < '1996-01-01' AND id % 3 <> 0 GROUP BY id)
SELECT id, CASE WHEN old.v IS NULL THEN 'tombstone' WHEN now.v IS NULL OR now.v <> old.v THEN 'restore' ELSE 'keep' END AS action, coalesce(old.v, now.v) AS version FROM now FULL JOIN old USING (id)""")
def rollback(spark, d):
    log = _log(spark, d)
    now = log.groupBy("id").agg(F.max("version").alias("version"))
    old = log.where("created_at < '1996-01-01' AND id % 3 <> 0").groupBy("id").agg(F.max("version").alias("version"))
    return vs.rollback(now, old)


def _branch(spark, d, status):
    rows = vs.latest(_log(spark, d).where(F.col("branch") == status), ["id"])
    return rows.select("id", F.substring("content", 3, 20).alias("content"), (F.col("version") / 10).alias("confidence"), F.array("content", F.lit("t")).alias("tags"), "version", F.col("created_at").alias("updated_at"))


_BR = f"""WITH {_LOG}, br AS (SELECT id, branch, substr(content, 3, 20) AS content, version / 10 AS confidence, [content, 't'] AS tags, version, created_at AS updated_at FROM log QUALIFY row_number() OVER (PARTITION BY id, branch ORDER BY version DESC) = 1),
j AS (SELECT id, a.version AS av, b.version AS bv, a.content AS ac, b.content AS bc, a.confidence AS af, b.confidence AS bf, a.tags AS ag, b.tags AS bg, a.updated_at AS au, b.updated_at AS bu,
  a.version IS NOT NULL AND b.version IS NOT NULL AND a.version <> b.version AS conflict FROM (SELECT * FROM br WHERE branch = 'O') a FULL JOIN (SELECT * FROM br WHERE branch = 'F') b USING (id)),
t AS (SELECT *, av IS NULL OR (conflict AND TAKE) AS tb, MERGED AS mg FROM j)
SELECT id, CASE WHEN tb THEN bc ELSE ac END AS content, round(CASE WHEN mg THEN greatest(af, bf) WHEN tb THEN bf ELSE af END, 6) AS confidence,
 list_sort(CASE WHEN mg THEN list_distinct(list_concat(ag, bg)) WHEN tb THEN bg ELSE ag END) AS tags, CASE WHEN tb THEN bv ELSE av END AS version, CASE WHEN mg THEN 'merged' WHEN tb THEN 'theirs' ELSE 'ours' END AS from_ FROM t"""


def _merge(policy: str, take: str, merged: str = "false"):
    @query(_BR.replace("TAKE", take).replace("MERGED", merged), name=f"branch_merge_{policy}")
    def run(spark, d):
        return vs.merge_branches(_branch(spark, d, "O"), _branch(spark, d, "F"), policy).drop("updated_at").withColumn("confidence", F.round("confidence", 6))


_merge("latest", "bu > au")
_merge("ours", "false")
_merge("theirs", "true")
_merge("merge", "bu > au", "conflict AND ac = bc")


@query("""WITH r(r_agent, r_namespace, permission) AS (VALUES ('*', '*', 'read'), ('BUILDING', '*', 'write'), ('*', '3', 'none'), ('BUILDING', '3', 'admin'), ('MACHINERY', '5', 'admin'))
SELECT agent, namespace, coalesce(arg_max(permission, ((r_agent <> '*')::INT, (r_namespace <> '*')::INT)), 'none') AS permission FROM (SELECT DISTINCT c_mktsegment AS agent, c_nationkey::VARCHAR AS namespace FROM customer) LEFT JOIN r ON r_agent IN ('*', agent) AND r_namespace IN ('*', namespace) GROUP BY ALL""")
def acl_effective_permission(spark, d):
    rules = spark.createDataFrame([("*", "*", "read"), ("BUILDING", "*", "write"), ("*", "3", "none"), ("BUILDING", "3", "admin"), ("MACHINERY", "5", "admin")], "r_agent string, r_namespace string, permission string")
    agents = table(spark, d, "customer").select(F.col("c_mktsegment").alias("agent"), F.col("c_nationkey").cast("string").alias("namespace")).distinct()
    return vs.effective_permission(agents, rules)


def _clocks(spark, d):
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("clock"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT a.user_id AS a, b.user_id AS b FROM (SELECT DISTINCT user_id FROM events) a JOIN (SELECT DISTINCT user_id FROM events) b ON b.user_id = a.user_id + 1),
t AS (SELECT a AS user_id, e.event_type, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM p, (SELECT DISTINCT event_type FROM events) e LEFT JOIN c x ON x.user_id = a AND x.event_type = e.event_type LEFT JOIN c y ON y.user_id = b AND y.event_type = e.event_type)
SELECT user_id, CASE WHEN bool_or(x < y) AND bool_or(x > y) THEN 'concurrent' WHEN bool_or(x < y) THEN 'before' WHEN bool_or(x > y) THEN 'after' ELSE 'equal' END AS clock_order, sum(greatest(x, y))::BIGINT AS merged_total FROM t GROUP BY user_id""")
def vector_clocks(spark, d):
    c = _clocks(spark, d)
    pairs = c.join(c.select((F.col("user_id") - 1).alias("user_id"), F.col("clock").alias("other")), "user_id")
    total = F.aggregate(F.map_values(vs.merge_clocks(F.col("clock"), F.col("other"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.select("user_id", vs.clock_order(F.col("clock"), F.col("other")).alias("clock_order"), total.alias("merged_total"))


def _resolve(policy: str, cond: str):
    sql = f"""WITH {_LOG}, l AS (SELECT id, arg_max((version, created_at), version) AS a, arg_min((version, created_at), (price, version)) AS b FROM log GROUP BY id)
    SELECT id, CASE WHEN {cond} THEN b[1] ELSE a[1] END AS version FROM l"""

    @query(sql, name=f"conflict_{policy}")
    def run(spark, d):
        state = F.struct("version", "created_at", F.col("created_at").alias("updated_at"))
        per = _log(spark, d).groupBy("id").agg(F.max_by(state, "version").alias("a"), F.min_by(state, F.struct("price", "version")).alias("b"))
        return per.select("id", vs.resolve(F.col("a"), F.col("b"), policy)["version"].alias("version"))


_resolve("lww", "b[2] > a[2]")
_resolve("fww", "b[2] < a[2]")
_resolve("version", "b[1] > a[1]")


@query("SELECT o_orderkey AS id, CASE WHEN up THEN 'in' ELSE o_orderstatus END AS content, CASE WHEN up THEN 2 ELSE 1 END AS version FROM (SELECT *, o_orderkey % 2 = 0 AND o_orderkey % 3 = 2 AS up FROM orders)")
def upsert_newer(spark, d):
    o = table(spark, d, "orders")
    base = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("content"), F.lit(1).cast("long").alias("version"))
    incoming = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("in").alias("content"), (F.col("o_orderkey") % 3).alias("version"))
    # equal versions go to the incoming side only where it is higher
    return vs.upsert(base, incoming, "id", "newer")
