"""Calibration, entity resolution and token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import calibration as cal
from tarnfold.operators import conversation as cv
from tarnfold.operators import entities as en
from tarnfold.plans.registry import query, table
from tarnfold.plans.texts import TIERS

# Scores are the first component to one digit, so a score has many rows; labels of 5 and more are positive.
_S = "d AS (SELECT vec_id, round(embedding[1]::DOUBLE, 1) AS s, (label >= 5)::INT AS y FROM embeddings), c AS (SELECT s, count(*) AS n, sum(y) AS y FROM d GROUP BY s)"
_NEWTON = f"""WITH RECURSIVE {_S}, f AS (SELECT 0 AS step, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b
UNION ALL SELECT step + 1, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
  SELECT step, a, b, sum((n * p - y) * s) AS ga, sum(n * p - y) AS gb, sum(n * p * (1 - p) * s * s) AS aa, sum(n * p * (1 - p) * s) AS ab, sum(n * p * (1 - p)) AS bb
  FROM (SELECT f.*, c.*, 1 / (1 + exp(-(a * s + b))) AS p FROM f, c WHERE step < 12) GROUP BY step, a, b))"""


def _scored(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 1).alias("score"), (F.col("label") >= 5).cast("int").alias("label"))


@query(f"{_NEWTON} SELECT vec_id, round(1 / (1 + exp(-(a * s + b))), 6) AS calibrated FROM d, f WHERE step = 12")
def calibration_platt(spark, d):
    rows = _scored(spark, d)
    a, b = cal.fit_platt(rows)
    return rows.select("vec_id", F.round(1 / (1 + F.exp(-(a * F.col("score") + b))), 6).alias("calibrated"))


_MINMAX_POOL = f"""WITH {_S}, x AS (SELECT s, row_number() OVER (ORDER BY s) AS i, sum(n) OVER (ORDER BY s) AS cn, sum(y) OVER (ORDER BY s) AS cy, n, y FROM c),
p AS (SELECT i.s, j.i AS j, min((k.cy - j.cy + j.y) / (k.cn - j.cn + j.n)) AS m FROM x i JOIN x j ON j.i <= i.i JOIN x k ON k.i >= i.i GROUP BY i.s, j.i), z AS (SELECT s, max(m) AS value FROM p GROUP BY s)"""


@query(f"{_MINMAX_POOL} SELECT vec_id, round(value, 6) AS calibrated FROM d JOIN z USING (s)")
def calibration_isotonic(spark, d):
    """Pooled in parts and a tree; the SQL has the same fit by its max-min formula."""
    rows = _scored(spark, d)
    return cal.isotonic(rows, cal.fit_isotonic(rows)).select("vec_id", F.round("calibrated", 6).alias("calibrated"))


@query(f"{_MINMAX_POOL} SELECT min(s) AS low, max(s) AS high, round(value, 6) AS value, sum(n)::BIGINT AS n FROM c JOIN z USING (s) GROUP BY z.value")
def calibration_blocks(spark, d):
    return cal.fit_isotonic(_scored(spark, d)).withColumn("value", F.round("value", 6))


_NAMES = """n AS (SELECT c_custkey * 4 AS id, 'customer' AS type, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 4 + 1, 'supplier', s_name FROM supplier UNION ALL SELECT p_partkey * 4 + 2, 'part', p_name FROM part),
o AS (SELECT type, lower(trim(name)) AS name, min(id) AS first FROM n GROUP BY ALL)"""
_LINKS = "l AS MATERIALIZED (SELECT a.first AS a, b.first AS b FROM o a JOIN o b ON a.type = b.type AND a.first < b.first AND abs(length(a.name) - length(b.name)) <= 6 AND jaro_winkler_similarity(a.name, b.name) >= 0.985 - 1e-12)"


def _entities(spark, d):
    kinds = (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))
    parts = [table(spark, d, t).select((F.col(k) * 4 + i).cast("long").alias("id"), F.lit(t).alias("type"), F.col(n).alias("name")) for i, (t, k, n) in enumerate(kinds)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH RECURSIVE {_NAMES}, {_LINKS}, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(id, root) AS (SELECT first, first FROM o UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id AND r.root < e.b), m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT n.id, m.root AS entity FROM n JOIN o ON o.type = n.type AND o.name = lower(trim(n.name)) JOIN m ON m.id = o.first""")
def resolve_entities(spark, d):
    """Names of customers, suppliers and parts: equal ones and those of a Jaro-Winkler of 0.985 or more are one entity."""
    return en.resolve(_entities(spark, d), 0.985)


@query(f"WITH {_NAMES}, {_LINKS} SELECT a, b FROM l")
def similar_names(spark, d):
    one = _entities(spark, d).groupBy("type", F.lower(F.trim("name")).alias("name")).agg(F.min("id").alias("id"))
    return en.similar_names(one, 0.985).select("a", "b")


_TOKENS = r"len(regexp_extract_all(X, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"


@query(rf"""WITH t AS (SELECT *, coalesce({_TOKENS.replace('X', 'text')}, 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations),
a AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total, CASE WHEN role = 'system' THEN 'system' WHEN b <= 2 THEN 'recent' WHEN b <= 4 THEN 'medium' ELSE 'old' END AS tier FROM t),
o AS (SELECT * FROM a WHERE total > 300),
{TIERS},
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, tier ORDER BY CASE WHEN tier = 'recent' THEN -turn ELSE turn END) AS upto FROM (SELECT *, {_TOKENS.replace('X', 'content')} AS tokens FROM m)),
g1 AS (SELECT *, 300 AS r1, coalesce(max(upto) FILTER (tier = 'system' AND upto <= 300) OVER w, 0) AS u1 FROM s WINDOW w AS (PARTITION BY conv_id)),
g2 AS (SELECT *, 300 - u1 AS r2, coalesce(max(upto) FILTER (tier = 'recent' AND upto <= 300 - u1) OVER w, 0) AS u2 FROM g1 WINDOW w AS (PARTITION BY conv_id)),
g3 AS (SELECT *, least(r2 - u2, 75) AS r3, coalesce(max(upto) FILTER (tier = 'old' AND upto <= least(r2 - u2, 75)) OVER w, 0) AS u3 FROM g2 WINDOW w AS (PARTITION BY conv_id)),
g4 AS (SELECT *, least(r2 - u2 - u3, 100 + 75 - u3) AS r4 FROM g3)
SELECT conv_id, turn, tier, content, tokens FROM g4 WHERE upto <= CASE tier WHEN 'system' THEN r1 WHEN 'recent' THEN r2 WHEN 'old' THEN r3 ELSE r4 END
UNION ALL SELECT conv_id, turn, 'whole', text, n FROM a WHERE total <= 300""")
def tiered_budget(spark, d):
    return cv.tiered_budget(table(spark, d, "conversations"), 300, 2, 2)
