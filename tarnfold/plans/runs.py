"""Conflicts, consolidation runs, similarity, stores and summaries. Inputs that need patterns are sentences made of columns,
the same in query and SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.operators import conflicts as cf
from tarnfold.operators import lifecycle as lc
from tarnfold.operators import retrieval as rt
from tarnfold.operators import similarity as sm
from tarnfold.operators import summaries as su
from tarnfold.plans.analysis import MEMORIES, memories
from tarnfold.plans.consolidate import _HASH
from tarnfold.plans.registry import query, table
from tarnfold.plans.texts import SENTENCES
from tarnfold.session import checkpoint_dir
from tarnfold.sources import io

_PAIR = """SELECT c_custkey * 2 AS a_id, c_custkey * 2 + 1 AS b_id,
'the ' || lower(c_mktsegment) || ' team was ' || CASE c_custkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'late' WHEN 2 THEN 'ready on 2024-01-05' ELSE 'not ready' END AS a,
'the ' || lower(c_mktsegment) || ' team was ' || CASE c_custkey % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'ready now' WHEN 2 THEN 'ready on 2024-02-05' WHEN 3 THEN 'late' ELSE 'closed' END AS b,
CAST(c_custkey % 7 AS DOUBLE) / 20 + CAST(0.69 AS DOUBLE) AS similarity, CAST(c_custkey % 11 AS DOUBLE) / 10 AS a_conf, CAST(c_custkey % 3 AS DOUBLE) / 2 AS b_conf,
CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'src' || (c_custkey % 2) END AS a_source, 'src0' AS b_source, CAST(c_custkey % 10 AS DOUBLE) / 10 AS a_trust, CAST(0.9 AS DOUBLE) AS b_trust FROM customer"""
_STATED = r"(?i)(\w+(?:\s+\w+)?)\s+(?:is|are|was|were|=|:)\s+(.+)"
_CONFLICTS = rf"""p AS ({_PAIR}), v AS (SELECT *, regexp_extract(a, '{_STATED}', 2) AS va, regexp_extract(b, '{_STATED}', 2) AS vb, regexp_extract(a, '\d{{4}}-\d{{2}}-\d{{2}}') AS da, regexp_extract(b, '\d{{4}}-\d{{2}}-\d{{2}}') AS db FROM p WHERE similarity >= 0.7),
x AS (SELECT a_id, b_id, 'value_conflict' AS kind, CASE WHEN a_conf > 0.8 AND b_conf > 0.8 THEN 'critical' WHEN (a_conf > 0.8 OR b_conf > 0.8) AND (a_conf < 0.5 OR b_conf < 0.5) THEN 'medium'
WHEN contains(va, vb) OR contains(vb, va) OR (starts_with(va, 'ready on') AND starts_with(vb, 'ready on')) THEN 'low' ELSE 'high' END AS severity FROM v WHERE va <> vb
UNION ALL SELECT a_id, b_id, 'temporal_conflict', 'medium' FROM v WHERE da <> '' AND db <> '' AND da <> db
UNION ALL SELECT a_id, b_id, 'confidence_gap', 'low' FROM v WHERE abs(a_conf - b_conf) >= 0.5 AND similarity > 0.9
UNION ALL SELECT a_id, b_id, 'semantic_contradiction', 'medium' FROM v WHERE contains(a, 'was not')
UNION ALL SELECT a_id, b_id, 'source_conflict', 'low' FROM v WHERE a_source <> b_source AND similarity > 0.95 AND abs(a_trust - b_trust) > 0.3)"""


def _pairs(spark, d):
    cols = _PAIR.removeprefix("SELECT ").removesuffix(" FROM customer")
    table(spark, d, "customer").createOrReplaceTempView("_pair_customers")
    return spark.sql(f"SELECT {cols} FROM _pair_customers")


@query(f"WITH {_CONFLICTS} SELECT a_id, b_id, kind, severity FROM x")
def memory_conflicts(spark, d):
    return cf.conflicts(_pairs(spark, d))


@query(f"WITH {_CONFLICTS} SELECT kind, severity, count(*) AS n FROM x GROUP BY ALL")
def conflict_summary(spark, d):
    return cf.conflict_summary(cf.conflicts(_pairs(spark, d)))


def _winner(strategy: str, sql: str):
    @query(f"WITH p AS ({_PAIR}) SELECT a_id, b_id, CASE WHEN {sql} THEN a_id ELSE b_id END AS winner FROM p", name=f"conflict_winner_{strategy}")
    def run(spark, d):
        at = F.col("a_id") % 9, F.col("b_id") % 7
        return _pairs(spark, d).select("a_id", "b_id", cf.winner(F.col("a_id"), F.col("b_id"), strategy, F.col("a_conf"), F.col("b_conf"), *at).alias("winner"))


_winner("confidence_wins", "a_conf >= b_conf")
_winner("latest_wins", "a_id % 9 >= b_id % 7")

_PLANS = "SELECT c_custkey AS id, 'the yearly plan of the ' || lower(c_mktsegment) || ' team was said to be v' || (c_custkey % 7) AS content, CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence FROM customer"


def _plan_memories(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("_plan_customers")
    return spark.sql(_PLANS.replace("FROM customer", "FROM _plan_customers"))


@query(f"""WITH p AS ({_PLANS}), t AS (SELECT DISTINCT content, regexp_extract(content, 'the (\\w+) team', 1) AS seg FROM p),
c AS (SELECT (SELECT count(*) FROM p) AS memories, (SELECT count(*) FROM p) - (SELECT count(*) FROM t) AS duplicates, (SELECT sum(n * (n - 1) / 2)::BIGINT FROM (SELECT count(*) AS n FROM t GROUP BY seg)) AS conflicts, 1::BIGINT AS clusters)
SELECT *, printf('Found %d potential duplicates. Run consolidation to remove them.|Detected %d conflicts. Review and resolve to maintain data consistency.|Found %d similarity clusters. Consider merging related memories.', duplicates, conflicts, clusters) AS advice FROM c""")
def consolidation_report(spark, d):
    rows = _plan_memories(spark, d)
    return cf.report(rows, cf.consolidate(rows))


@query(f"WITH p AS ({_PLANS}) SELECT id, min(id) OVER (PARTITION BY content) AS kept FROM p")
def consolidation_duplicates(spark, d):
    return cf.consolidate(_plan_memories(spark, d))["duplicates"]


@query(f"SELECT (doc_id // 100)::BIGINT AS batch, sum(n)::BIGINT AS memories, (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT doc_id // 100 * 100 AS doc_id, {_HASH} AS h, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def batch_consolidation(spark, d):
    return cf.batch_duplicates(table(spark, d, "documents"), "doc_id", 100, "text")


def _neighbours(spark, d):
    e = table(spark, d, "embeddings")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    one = e.join(t, "vec_id").select(F.col("vec_id").alias("id"), F.col("text").alias("a"), F.col("embedding").alias("va"))
    return one.join(one.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"), F.col("va").alias("vb")), "id")


_NEXT = "n AS (SELECT x.vec_id AS id, dx.text AS a, dy.text AS b, x.embedding::DOUBLE[] AS va, y.embedding::DOUBLE[] AS vb FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 JOIN documents dx ON dx.doc_id = x.vec_id JOIN documents dy ON dy.doc_id = y.vec_id)"


@query(f"WITH {_NEXT} SELECT id, round(list_cosine_similarity(va, vb), 6) AS similarity FROM n")
def pair_similarity_semantic(spark, d):
    return sm.pair_similarity(_neighbours(spark, d), "semantic").select("id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_NEXT} SELECT id, (trim(lower(a)) = trim(lower(b)))::INT::DOUBLE AS similarity FROM n")
def pair_similarity_exact(spark, d):
    return sm.pair_similarity(_neighbours(spark, d), "exact").select("id", "similarity")


@query()
def pair_similarity_hybrid(spark, d):
    """Each turn with the next one of its conversation; vectors by conversation, missing for some."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = turns.withColumnRenamed("text", "a").join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])
    pairs = pairs.join(e.select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("va")), "conv_id", "left").join(e.select((F.col("vec_id") - 1).alias("conv_id"), F.col("embedding").alias("vb")), "conv_id", "left")
    return sm.pair_similarity(pairs, "hybrid").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query()
def semantic_groups(spark, d):
    return sm.semantic_groups(table(spark, d, "embeddings"))


_FACT = "SELECT c_custkey AS id, lower(c_mktsegment) AS domain, 'Home city ' || (c_custkey % 3) AS key, CASE c_custkey % 4 WHEN 0 THEN 'Oslo by the sea' WHEN 1 THEN 'oslo by the sea' WHEN 2 THEN 'Oslo by a sea' ELSE 'Rome' END AS value, CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence, 'src' || (c_custkey % 5) AS source FROM customer"


def _facts(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("_fact_customers")
    return spark.sql(_FACT.replace("FROM customer", "FROM _fact_customers"))


@query(f"WITH f AS ({_FACT}) SELECT id FROM f WHERE domain = 'building' AND lower(key) = 'home city 1' AND lower(value) = 'oslo by the sea'")
def duplicates_of_fact(spark, d):
    return sm.duplicates_of(_facts(spark, d), {"domain": "building", "key": "home CITY 1", "value": "Oslo by the SEA"}, "exact").select("id")


@query(f"""WITH f AS ({_FACT}), w AS (SELECT *, list_distinct(string_split(lower(key), ' ')) AS k, list_distinct(string_split(lower(value), ' ')) AS v, ['home', 'city', '1'] AS ok, ['oslo', 'by', 'the', 'sea'] AS ov FROM f WHERE domain = 'building'),
s AS (SELECT id, 0.3 * len(list_intersect(k, ok)) / (len(k) + 3 - len(list_intersect(k, ok))) + 0.7 * len(list_intersect(v, ov)) / (len(v) + 4 - len(list_intersect(v, ov))) AS s FROM w) SELECT id FROM s WHERE s >= 0.7""")
def similar_to_fact(spark, d):
    return sm.duplicates_of(_facts(spark, d), {"domain": "building", "key": "home city 1", "value": "oslo by the sea"}, "fuzzy", 0.7).select("id")


@query()
def fact_groups_fuzzy(spark, d):
    return sm.fact_groups(_facts(spark, d), "id")


def _folder(spark, what: str) -> str:
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


_ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("branch", T.StringType()), T.StructField("is_deleted", T.BooleanType())])


def _store_rows(spark, d):
    return memories(spark, d).select(F.col("doc_id").alias("id"), "content", F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("main").alias("branch"), "is_deleted")


@query(f"WITH {MEMORIES} SELECT doc_id AS id, md5(content) AS content_md5, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'main' END AS branch, is_deleted FROM m")
def store_json_roundtrip(spark, d):
    path = _folder(spark, "store")
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("branch"))
    io.write_store(_store_rows(spark, d), commits, path)
    return io.read_store(spark, path, _ROW).select("id", F.md5("content").alias("content_md5"), "branch", "is_deleted")


def _import(merge: bool, kept: str):
    @query(f"SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'base' END AS origin FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 2 = 0 AND {kept})", name=f"store_import_{'merge' if merge else 'clear'}")
    def run(spark, d):
        rows = _store_rows(spark, d).select("id", "branch")
        base = rows.where("id % 2 = 0").withColumn("origin", F.lit("base"))
        return io.import_store(base, rows.where("id % 3 = 0").withColumn("origin", F.lit("new")), merge, "main").select("id", "origin")


_import(True, "TRUE")
_import(False, "doc_id % 5 = 0")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 <> 0 THEN 'insert' WHEN doc_id % 5 > doc_id % 4 THEN 'update' ELSE 'skip' END AS action FROM documents WHERE doc_id % 3 = 0")
def team_import_actions(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return lc.team_actions(rows.where("id % 2 = 0").withColumn("version", F.col("id") % 4), rows.where("id % 3 = 0").withColumn("version", F.col("id") % 5))


@query("SELECT lang, list_sort(list(DISTINCT t))[1:10] AS topics FROM (SELECT lang, source AS t FROM documents UNION ALL SELECT lang, 'd' || (doc_id % 15) FROM documents) GROUP BY lang")
def topics(spark, d):
    rows = table(spark, d, "documents").select("lang", F.col("source").alias("category"), F.array(F.concat(F.lit("d"), (F.col("doc_id") % 15).cast("string"))).alias("tags"))
    return su.topics(rows, ["lang"])


@query(f"""WITH {SENTENCES} SELECT coalesce(source, 'uncategorized') AS category, row_number() OVER (PARTITION BY coalesce(source, 'uncategorized') ORDER BY score DESC, doc_id, pos)::INT AS rank, doc_id, sentence FROM s QUALIFY rank <= 2""")
def category_summaries(spark, d):
    return su.by_category(table(spark, d, "documents"), "source", "text")


def _talk(spark, d):
    return table(spark, d, "conversations")


@query()
def running_summaries(spark, d):
    """Two batches: the first three turns, then the others."""
    none = spark.createDataFrame([], "conv_id long, summary string, sources long")
    first = su.running_summary(none, _talk(spark, d).where("turn < 3"), "conv_id", "turn", "text")
    return su.running_summary(first.withColumn("sources", F.col("sources").cast("long")), _talk(spark, d).where("turn >= 3"), "conv_id", "turn", "text")


@query()
def auto_compression(spark, d):
    return su.auto_strategy(_talk(spark, d), 120)


@query(f"""WITH f AS ({_FACT}), w AS (SELECT domain, lower(key) AS key, value, source, confidence * CASE source WHEN 'src0' THEN 0.9 WHEN 'src1' THEN 1.0 WHEN 'src2' THEN 0.2 ELSE 0.5 END AS confidence FROM f)
SELECT domain, key, value, source, round(confidence, 6) AS confidence FROM w QUALIFY row_number() OVER (PARTITION BY domain, key ORDER BY confidence DESC, value, source) = 1""")
def weighted_merge(spark, d):
    weights = spark.createDataFrame([("src0", 0.9), ("src1", 1.7), ("src2", 0.2)], "source string, weight double")
    return lc.weighted_merge(_facts(spark, d), weights).withColumn("confidence", F.round("confidence", 6))


@query()
def weighted_summaries(spark, d):
    return su.weighted_summary(table(spark, d, "documents"), ["source"], "text", "doc_id", (F.col("doc_id") % 100) / 100)


@query(f"""WITH p AS ({_PLANS}), c AS (SELECT content, count(*) AS n FROM p GROUP BY 1) SELECT sum(n)::BIGINT AS memories, sum(n - 1)::BIGINT AS exact, count(*) FILTER (n > 1) AS groups FROM c""")
def duplicate_estimate_exact(spark, d):
    return cf.estimate(_plan_memories(spark, d)).select("memories", "exact", "groups")


@query()
def duplicate_estimate(spark, d):
    return cf.estimate(_plan_memories(spark, d))


_QS = "q AS (SELECT list(embedding::DOUBLE[] ORDER BY vec_id) AS q FROM embeddings WHERE vec_id IN (0, 7, 11, 13))"


@query(f"""WITH {_QS}, s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q[1]) + 0.3 * (list_cosine_similarity(embedding::DOUBLE[], q[2]) + list_cosine_similarity(embedding::DOUBLE[], q[3]) + list_cosine_similarity(embedding::DOUBLE[], q[4])) / 3 AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.1 ORDER BY s.score DESC, vec_id LIMIT 20""")
def expanded_search(spark, d):
    e = table(spark, d, "embeddings")
    q = {r["vec_id"]: list(r["embedding"]) for r in e.where("vec_id IN (0, 7, 11, 13)").collect()}  # four vectors of one question
    return rt.expanded_search(e, q[0], [q[7], q[11], q[13]], 20, least=0.1).withColumn("score", F.round("score", 6))
