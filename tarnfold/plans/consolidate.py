"""Duplicates, clusters, merges, conflicts, round trips and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnfold.functions import text as tx
from tarnfold.operators import consolidation as co
from tarnfold.plans.analysis import MEMORIES, memories
from tarnfold.plans.registry import query, table
from tarnfold.session import checkpoint_dir, cut
from tarnfold.sources import io
from tarnfold.streaming import jobs

_HASH = r"sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"


def _docs(spark, d):
    return table(spark, d, "documents")


@query(f"SELECT {_HASH} AS content_hash, min(doc_id) AS first, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    return co.exact_groups(_docs(spark, d))


def _keep(strategy: str, order: str):
    @query(f"WITH {MEMORIES} SELECT doc_id, row_number() OVER (PARTITION BY {_HASH.replace('text', 'content')} ORDER BY {order}) = 1 AS keep FROM m", name=f"dedup_keep_{strategy}")
    def run(spark, d):
        return co.keepers(memories(spark, d), tx.content_hash(F.col("content")), strategy)


_keep("newest", "created_at DESC, doc_id")
_keep("oldest", "created_at, doc_id")
_keep("confidence", "confidence DESC, doc_id")

_PAIRS = rf"""r AS (SELECT min(doc_id) AS id, list_distinct(regexp_extract_all(lower(min(text)), '[^ \t\n\r\f\x0b]+')) AS w FROM documents GROUP BY {_HASH}),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM r a JOIN r b ON a.id < b.id AND len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w)),
s AS (SELECT a, b, i / (na + nb - i) AS similarity FROM p WHERE i / (na + nb - i) >= 0.8 - 1e-12)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM s")
def near_dups_jaccard(spark, d):
    return co.near_pairs(_docs(spark, d)).withColumn("similarity", F.round("similarity", 6))


_CL = f"""WITH RECURSIVE {_PAIRS.replace('s AS (SELECT a, b', 's AS MATERIALIZED (SELECT a, b')}, e AS MATERIALIZED (SELECT a, b FROM s UNION SELECT b, a FROM s),
c(id, m) AS (SELECT a, a FROM e UNION SELECT e.b, c.m FROM c JOIN e ON e.a = c.id AND c.m < e.b), k AS (SELECT id, min(m) AS cluster FROM c GROUP BY id)"""


@query(f"{_CL} SELECT id, cluster FROM k")
def dup_clusters(spark, d):
    return co.clusters(co.near_pairs(_docs(spark, d)))


@query(f"{_CL} SELECT cluster, count(*) AS pairs, round(avg(similarity), 6) AS avg_similarity, round(min(similarity), 6) AS min_similarity, round(max(similarity), 6) AS max_similarity FROM s JOIN k ON k.id = a GROUP BY cluster")
def cluster_stats(spark, d):
    pairs = cut(co.near_pairs(_docs(spark, d)))
    got = co.cluster_stats(pairs, co.clusters(pairs))
    return got.withColumns({c: F.round(c, 6) for c in ("avg_similarity", "min_similarity", "max_similarity")})


@query(f"{_CL}, m AS (SELECT id, avg(similarity) AS v FROM (SELECT a AS id, similarity FROM s UNION ALL SELECT b, similarity FROM s) GROUP BY id) SELECT cluster, arg_max(m.id, (round(v, 9), -m.id)) AS centroid FROM m JOIN k USING (id) GROUP BY cluster")
def cluster_centroids(spark, d):
    pairs = cut(co.near_pairs(_docs(spark, d)))
    return co.centroids(pairs, co.clusters(pairs))


@query()
def fuzzy_ratio_pairs(spark, d):
    return co.fuzzy_pairs(_docs(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query()
def greedy_groups(spark, d):
    return co.greedy_leaders(_docs(spark, d))


def _merge(strategy: str, text: str):
    """Whole contents, compared by md5."""

    @query(f"WITH {MEMORIES}, g AS (SELECT *, doc_id % 100 AS grp, content AS c FROM m) SELECT grp, md5({text}) AS content_md5, round(least(1, avg(confidence) + 0.1 * count(*)), 6) AS confidence, count(*) AS members FROM g GROUP BY grp", name=f"merge_{strategy}")
    def run(spark, d):
        rows = memories(spark, d).select("doc_id", (F.col("doc_id") % 100).alias("grp"), "content", "confidence")
        return co.merged(rows, "grp", strategy).select("grp", F.md5("content").alias("content_md5"), F.round("confidence", 6).alias("confidence"), "members")


_merge("keep_best", "arg_max(c, (length(c), confidence, -doc_id))")
_merge("concat", "array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list(c ORDER BY doc_id), lambda x: [x])), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END), '; ')")

_NEG = " OR ".join(f"(contains(lower(a), '{n.replace(chr(39), chr(39) * 2)}') AND contains(lower(b), '{p}') AND NOT contains(lower(b), '{n.replace(chr(39), chr(39) * 2)}')) OR (contains(lower(b), '{n.replace(chr(39), chr(39) * 2)}') AND contains(lower(a), '{p}') AND NOT contains(lower(a), '{n.replace(chr(39), chr(39) * 2)}'))" for n, p in co.NEGATIONS)
_AB = "ab AS (SELECT c_custkey AS id, 'the plan of ' || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' is not ready' WHEN 1 THEN ' is ready' ELSE ' was fine' END AS a, 'the plan of ' || c_mktsegment || CASE c_custkey % 5 WHEN 0 THEN ' isn''t late' WHEN 1 THEN ' is late' ELSE ' is ready' END AS b, (c_custkey % 10) / 10 AS s FROM customer)"


@query(f"WITH {_AB} SELECT id, {_NEG} AS contradiction, regexp_extract(lower(a), '([a-z ]+?) is (\\w+)', 1) <> '' AND regexp_extract(lower(a), '([a-z ]+?) is (\\w+)', 1) = regexp_extract(lower(b), '([a-z ]+?) is (\\w+)', 1) AND regexp_extract(lower(a), '([a-z ]+?) is (\\w+)', 2) <> regexp_extract(lower(b), '([a-z ]+?) is (\\w+)', 2) AS value_conflict FROM ab")
def text_conflicts(spark, d):
    rows = table(spark, d, "customer").selectExpr(*_ab_columns())
    return rows.select("id", co.contradicts(F.col("a"), F.col("b")).alias("contradiction"), co.value_conflict(F.col("a"), F.col("b")).alias("value_conflict"))


def _ab_columns() -> list[str]:
    return [
        "c_custkey AS id",
        "concat('the plan of ', c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN ' is not ready' WHEN 1 THEN ' is ready' ELSE ' was fine' END) AS a",
        "concat('the plan of ', c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN ' isn\\'t late' WHEN 1 THEN ' is late' ELSE ' is ready' END) AS b",
        "(c_custkey % 10) / 10 AS s",
    ]


@query(f"WITH {_AB} SELECT id, CASE WHEN s >= 0.95 THEN 'skip' WHEN s >= 0.7 AND id % 2 = 0 THEN 'review' WHEN s >= 0.7 THEN 'add_and_link' ELSE 'add' END AS decision FROM ab")
def incremental_decision(spark, d):
    rows = table(spark, d, "customer").selectExpr(*_ab_columns())
    return rows.select("id", co.incremental_decision(F.col("s"), F.col("id") % 2 == 0).alias("decision"))


def _folder(spark, what: str) -> str:
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _as_memories(spark, d):
    m = memories(spark, d)
    return m.select(F.col("doc_id").cast("string").alias("id"), "content", "source", "confidence", "tags", F.col("created_at").cast("timestamp").alias("created_at"), F.lit(1).alias("version"), F.lit("main").alias("branch"))


_ROUND = f"WITH {MEMORIES} SELECT doc_id::VARCHAR AS id, md5(content) AS content_md5, source, round(confidence, 6) AS confidence, array_to_string(tags, ',') AS tags, 1 AS version FROM m"


def _shown(df):
    return df.select("id", F.md5("content").alias("content_md5"), "source", F.round("confidence", 6).alias("confidence"), F.array_join("tags", ",").alias("tags"), "version")


@query(_ROUND)
def jsonl_roundtrip(spark, d):
    path = _folder(spark, "jsonl")
    io.write_jsonl(_as_memories(spark, d), path, compress=True)
    return _shown(io.read_jsonl(spark, path)[0])


@query(_ROUND)
def csv_roundtrip(spark, d):
    path = _folder(spark, "csv")
    io.write_csv(_as_memories(spark, d), path)
    return _shown(io.read_csv(spark, path))


@query(_ROUND)
def parquet_roundtrip(spark, d):
    path = _folder(spark, "parquet")
    io.write_parquet(_as_memories(spark, d), path)
    return _shown(io.read_parquet(spark, path))


@query("SELECT branch, count(*) AS n, sum(length(v))::BIGINT AS chars FROM (SELECT 'main' AS branch, printf('## %s' || chr(10) || chr(10) || '%s' || chr(10) || chr(10) || '- source: %s' || chr(10) || '- confidence: %.2f' || chr(10) || '- tags: %s' || chr(10), doc_id::VARCHAR, text, source, (doc_id % 100) / 100, lang || ', ' || source) AS v FROM documents) GROUP BY branch")
def markdown_export(spark, d):
    return io.to_markdown(_as_memories(spark, d)).groupBy("branch").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


def _import(policy: str, who: str):
    @query(f"SELECT doc_id::VARCHAR AS id, CASE WHEN {who} THEN 'base' ELSE 'new' END AS origin FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0", name=f"import_{policy}")
    def run(spark, d):
        docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "doc_id")
        base = docs.where("doc_id % 2 = 0").select("id", F.lit("base").alias("origin"))
        return io.import_policy(base, docs.where("doc_id % 3 = 0").select("id", F.lit("new").alias("origin")), policy)


_import("skip", "doc_id % 2 = 0")
_import("replace", "doc_id % 2 = 0 AND doc_id % 3 <> 0")


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)")
def stream_windowed_counts(spark, d):
    """Windows that the watermark has closed, each appended once; state is that of the open ones."""
    events = jobs.stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    out = _folder(spark, "stream")
    jobs.run(jobs.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 hour", ["event_type"]), out + "/out", out + "/progress", "append")
    return jobs.appended(spark, out + "/out").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 1 HOUR AS closes_at, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, d):
    events = jobs.stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    out = _folder(spark, "stream")
    jobs.run(jobs.session_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "40 days", ["user_id"]), out + "/out", out + "/progress")
    return spark.read.parquet(out + "/out")


@query("SELECT o_custkey AS id, max(o_orderkey) AS version FROM orders GROUP BY o_custkey")
def stream_upsert(spark, d):
    orders = jobs.stream(spark, d, "orders.parquet", table(spark, d, "orders").schema)
    out = _folder(spark, "stream")
    jobs.upsert_batches(orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version")), out + "/table", "id", "version", out + "/progress")
    return jobs.latest_table(spark, out + "/table", 0)
