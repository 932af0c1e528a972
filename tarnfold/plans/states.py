"""Graph reasoning, memory states, registries and node tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tarnfold.functions import text as tx
from tarnfold.operators import lifecycle as lc
from tarnfold.operators import reasoning as rs
from tarnfold.plans.graphs import _E, edges
from tarnfold.plans.registry import query, table
from tarnfold.plans.texts import _T, said
from tarnfold.sources import io

NOW = datetime.datetime(2024, 2, 1)
_NOW = "TIMESTAMP '2024-02-01'"


def _entities(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("type")).agg(F.sum("p_size").alias("mentions"))


_N = "n AS (SELECT p_name AS name, p_brand AS type, sum(p_size)::BIGINT AS mentions FROM part GROUP BY ALL)"


@query(f"WITH {_N} SELECT * FROM n WHERE len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: starts_with(w, 'b'))) > 0 ORDER BY mentions DESC, name, type LIMIT 10")
def entity_prefix_search(spark, d):
    return rs.search_entities(_entities(spark, d), "B")


@query(f"WITH {_N}, b AS (SELECT * FROM n WHERE type = (SELECT min(type) FROM n)) SELECT * FROM b ORDER BY mentions DESC, name LIMIT 20 OFFSET 5")
def entity_listing(spark, d):
    e = _entities(spark, d)
    return rs.list_entities(e.join(F.broadcast(e.agg(F.min("type").alias("type"))), "type"), limit=20, offset=5).select("name", "type", "mentions")


_HITS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}' END" for name, words in rs.KEYWORDS.items())


@query(f"WITH {_T} SELECT id, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), ',') AS patterns FROM t")
def relation_patterns(spark, d):
    return said(spark, d).select("id", F.array_join(rs.pattern_hits(F.col("text")), ",").alias("patterns"))


@query(f"WITH {_E} SELECT type, count(*) AS n, CASE type WHEN 'PART_OF' THEN 'HAS_PART' WHEN 'LOCATED_IN' THEN 'CONTAINS' END AS inverse, CASE type WHEN 'PART_OF' THEN 'hierarchical' WHEN 'LOCATED_IN' THEN 'spatial' ELSE 'associative' END AS category FROM e GROUP BY type")
def relation_categories(spark, d):
    return edges(spark, d).groupBy("type").agg(F.count("*").alias("n")).withColumns({"inverse": rs.inverse(F.col("type")), "category": rs.category(F.col("type"))})


_G = """g AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS type, 0.9 AS confidence FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'PART_OF', 0.8 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'PART_OF', 0.6 FROM supplier
UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey + 1), 'SIMILAR_TO', 0.9 FROM supplier)"""


def _reasoned(spark, d):
    e = edges(spark, d).where("type <> 'SUPPLIES'").withColumns({"type": F.lit("PART_OF"), "confidence": F.when(F.startswith("src", F.lit("s")), 0.6).otherwise(F.col("confidence"))}).select("src", "dst", "type", "confidence")
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("dst"), F.lit("SIMILAR_TO").alias("type"), F.lit(0.9).alias("confidence"))
    return e.unionByName(s)


@query(f"""WITH {_G} SELECT a.src, b.dst, 'PART_OF' AS type, 'transitive_part_of' AS rule, round(max(a.confidence * b.confidence * 0.85), 6) AS confidence FROM g a JOIN g b ON b.src = a.dst AND b.type = 'PART_OF' WHERE a.type = 'PART_OF' GROUP BY a.src, b.dst HAVING max(a.confidence * b.confidence * 0.85) >= 0.5
UNION ALL SELECT dst, src, 'SIMILAR_TO', 'symmetric_similar', round(0.9 * 0.95, 6) FROM g WHERE type = 'SIMILAR_TO'""")
def inferred_relationships(spark, d):
    return rs.infer(_reasoned(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {_G}, q AS (SELECT 'c' || c_custkey AS src, 'r' || (c_custkey % 5) AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w AS (SELECT src, dst, 1 AS hops, confidence, src || ' ' || type || ' ' || dst AS chain FROM g UNION ALL SELECT a.src, b.dst, 2, a.confidence * b.confidence, a.src || ' ' || a.type || ' ' || a.dst || '; ' || b.src || ' ' || b.type || ' ' || b.dst FROM g a JOIN g b ON b.src = a.dst WHERE a.type = 'PART_OF' AND b.type = 'PART_OF')
SELECT src, dst, hops, round(confidence, 6) AS confidence, chain FROM q JOIN w USING (src, dst)""")
def explained_relationships(spark, d):
    of_customers = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string")).alias("dst"))
    of_nations = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return rs.explain(_reasoned(spark, d), of_customers.unionByName(of_nations)).withColumn("confidence", F.round("confidence", 6))


# ---------------------------------------------------------------- memory states over events


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _parts():
    """Valence, importance and strength of an event."""
    return F.col("event_id") % 5 - 2, F.col("value") / 100, (F.col("event_id") % 10) / 10


@query("SELECT event_id, round(abs(event_id % 5 - 2) / 2 * 0.3 + value / 100 * 0.4 + (event_id % 10) / 10 * 0.3, 6) AS salience FROM events")
def salience(spark, d):
    return _events(spark, d).select("event_id", F.round(lc.salience(*_parts()), 6).alias("salience"))


_FEEL = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 - 2 END"


@query(f"""SELECT event_id, round(value / 100, 6) AS important, round(least(1, event_id % 20 / 10), 6) AS frequent, round(coalesce(abs({_FEEL}) / 2, 0.5), 6) AS emotional,
round(value / 100 * 0.4 + (event_id % 10) / 10 * 0.3 + least(1, event_id % 20 / 10) * 0.2 + coalesce(abs({_FEEL}) / 2, 0.5) * 0.1, 6) AS combined, value / 100 >= 0.3 OR (event_id % 10) / 10 >= 0.2 OR event_id % 20 >= 1 AS consolidate FROM events""")
def consolidation_scores(spark, d):
    valence, importance, strength = _parts()
    feel, often = F.when(F.col("event_id") % 3 != 0, valence), F.col("event_id") % 20
    scores = {s: F.round(lc.consolidation_score(s, importance, strength, often, feel), 6) for s in ("important", "frequent", "emotional", "combined")}
    return _events(spark, d).select("event_id", *[c.alias(n) for n, c in scores.items()], lc.should_consolidate(importance, strength, often).alias("consolidate"))


@query("SELECT doc_id, round(((doc_id % 100) / 100 - 0.5) * 0.1, 6) AS boost, CASE WHEN (doc_id % 100) / 100 >= 0.95 THEN 'duplicate' WHEN (doc_id % 100) / 100 >= 0.9 THEN 'merge' WHEN (doc_id % 100) / 100 >= 0.8 THEN 'similar' ELSE 'different' END AS class FROM documents")
def confidence_boosts(spark, d):
    c = (F.col("doc_id") % 100) / 100
    return table(spark, d, "documents").select("doc_id", F.round(lc.confidence_boost(c), 6).alias("boost"), lc.similarity_class(c).alias("class"))


def _displaced(policy: str, order: str):
    @query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= n - 7", name=f"displaced_{policy}")
    def run(spark, d):
        rows = _events(spark, d).withColumns({"used": F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 50), "priority": (F.col("event_id") % 10) / 10, "activation": F.col("value") / 100})
        return lc.displaced_by(rows, policy, 7, ["user_id"], "event_id", "ts", "used", "priority", "activation", F.lit(NOW)).select("event_id", "user_id")


_displaced("oldest", "ts")
_displaced("priority", "event_id % 10")
_displaced("least_recent", "ts + to_seconds(event_id % 50)")


@query("SELECT event_id, round(least(1, value / 100 + CASE WHEN event_type IN ('click', 'signup') THEN 0.3 WHEN event_type = 'view' THEN 0.2 ELSE 0 END), 6) AS activation FROM events")
def rehearsed(spark, d):
    act = F.when(F.col("event_type") == "click", "focus").when(F.col("event_type") == "signup", "rehearse").when(F.col("event_type") == "view", "access")
    return _events(spark, d).select("event_id", F.round(lc.rehearsed(_parts()[1], F.coalesce(act, F.lit(""))), 6).alias("activation"))


@query("SELECT event_id, round(CASE WHEN row_number() OVER (ORDER BY ts DESC, event_id) <= 100 THEN least(1, (event_id % 10) / 10 + 0.3) ELSE (event_id % 10) / 10 END, 6) AS strength FROM events")
def sleep_consolidation(spark, d):
    got = lc.sleep_boosted(_events(spark, d).select("event_id", "ts", _parts()[2].alias("strength")), "ts", "event_id")
    return got.select("event_id", F.round("strength", 6).alias("strength"))


# ---------------------------------------------------------------- branches, registries, validation, nodes


@query("SELECT o_orderstatus AS branch, count(*) AS rows, max(o_orderdate) AS last_at FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def branches_after_delete(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("branch"), F.col("o_orderdate").alias("created_at"))
    return lc.branches(lc.without_branch(rows, "P"))


_ACT = "CASE event_type WHEN 'view' THEN 'verify' WHEN 'click' THEN 'trust' WHEN 'error' THEN 'block' END"


@query(f"""WITH p AS (SELECT DISTINCT source, CASE WHEN source = 'src1' THEN 'suspicious' ELSE 'unknown' END AS trust FROM documents), a AS (SELECT 'src' || (user_id % 40) AS source, event_id, {_ACT} AS act FROM events WHERE event_id % 17 = 0),
l AS (SELECT source, arg_max(act, event_id) AS act, bool_or(act = 'verify') AS v FROM a WHERE act IS NOT NULL GROUP BY source)
SELECT source, CASE act WHEN 'verify' THEN 'verified' WHEN 'block' THEN 'blocked' WHEN 'trust' THEN 'trusted' ELSE trust END AS trust, coalesce(v, FALSE) AS verified FROM p LEFT JOIN l USING (source)""")
def source_registry(spark, d):
    profiles = table(spark, d, "documents").select("source").distinct().select("source", F.when(F.col("source") == "src1", "suspicious").otherwise("unknown").alias("trust"), F.lit(False).alias("verified"))
    acts = table(spark, d, "events").where("event_id % 17 = 0").select(F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string")).alias("source"), F.col("event_id").alias("at"), F.expr(_ACT).alias("act"))
    return lc.registered(profiles, acts)


_CHECK = "CASE WHEN value < 5 THEN 'low' WHEN event_type = 'error' THEN 'error' END"


@query(f"SELECT event_id, {_CHECK} AS rejected FROM events")
def batch_validation(spark, d):
    return lc.validated(_events(spark, d), [("low", F.col("value") < 5), ("error", F.col("event_type") == "error")]).select("event_id", "rejected")


@query(f"WITH c AS (SELECT event_id, {_CHECK} AS rejected FROM events) SELECT event_id, rejected FROM c WHERE event_id <= (SELECT min(event_id) FROM c WHERE rejected IS NOT NULL)")
def batch_validation_fail_fast(spark, d):
    return lc.validated(_events(spark, d), [("low", F.col("value") < 5), ("error", F.col("event_type") == "error")], "event_id").select("event_id", "rejected")


@query("SELECT doc_id AS id, md5(text) AS content_md5, source, lang FROM documents")
def memory_projection(spark, d):
    got = lc.projected(table(spark, d, "documents"), {"doc_id": "id", "text": "content"}, {"metadata": ["source", "lang"]})
    return got.select("id", F.md5("content").alias("content_md5"), "metadata.source", "metadata.lang")


@query("""SELECT 'source' AS metric, source AS key, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'branch', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'bytes', 'documents', sum(strlen(text))::BIGINT FROM documents""")
def analytics_bundle(spark, d):
    docs = table(spark, d, "documents")
    count = lambda df, metric, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).select(F.lit("bytes").alias("metric"), F.lit("documents").alias("key"), F.col("n").cast("long"))
    return lc.union_all([count(docs, "source", F.col("source")), count(docs, "lang", F.col("lang")), count(_events(spark, d), "day", F.date_format("ts", "yyyy-MM-dd")), count(table(spark, d, "orders"), "branch", F.col("o_orderstatus")), size])


@query(f"SELECT CASE WHEN s_suppkey % 30 > 15 THEN 'failed' WHEN s_suppkey % 3 = 0 THEN 'joining' ELSE 'active' END AS state, count(*) AS nodes, sum(s_suppkey % 4)::BIGINT AS shards FROM supplier GROUP BY 1")
def cluster_health(spark, d):
    nodes = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "joining").otherwise("active").alias("state"), (F.lit(NOW) - F.make_dt_interval(secs=F.col("s_suppkey") % 30)).alias("last_heartbeat"), (F.col("s_suppkey") % 4).alias("shards"))
    return lc.cluster_health(nodes, F.lit(NOW))


@query("""WITH r AS (SELECT s_nationkey AS shard, s_name AS node, s_suppkey % 50 AS position FROM supplier), l AS (SELECT shard, node, 60 + shard - position AS lag FROM r)
SELECT shard, node, lag, row_number() OVER (PARTITION BY shard ORDER BY lag, node) = 1 AS promoted FROM l""")
def replica_lags(spark, d):
    replicas = table(spark, d, "supplier").select(F.col("s_nationkey").alias("shard"), F.col("s_name").alias("node"), (F.col("s_suppkey") % 50).alias("position"))
    primaries = table(spark, d, "nation").select(F.col("n_nationkey").alias("shard"), (F.col("n_nationkey") + 60).alias("position"))
    return lc.replica_lags(replicas, primaries)


# ---------------------------------------------------------------- texts and bytes


@query(r"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda x: length(x) >= 20) AS s FROM documents)""")
def sentences_after_marks(spark, d):
    s = tx.sentences_after_marks(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("sentences_md5"))


@query("SELECT vec_id, len(embedding) * 4 AS bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def float32_roundtrip(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", io.pack_float32("embedding").alias("blob"))
    back = rows.withColumn("v", io.unpack_float32("blob"))
    return back.select("vec_id", F.octet_length("blob").alias("bytes"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


_MERGE = "CASE c_custkey % 3 WHEN 0 THEN 'Oslo' WHEN 1 THEN 'oslo, Norway' ELSE 'Rome' END AS a, CASE c_custkey % 4 WHEN 0 THEN 'OSLO, norway' WHEN 1 THEN 'rome' ELSE 'Oslo' END AS b"


@query(f"SELECT id, CASE WHEN contains(lower(b), lower(a)) THEN b WHEN contains(lower(a), lower(b)) THEN a ELSE a || '; ' || b END AS value FROM (SELECT c_custkey AS id, {_MERGE} FROM customer)")
def default_merge(spark, d):
    a, b = (x.rsplit(" AS ", 1)[0] for x in _MERGE.split(" AS a, "))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), lc.default_merge(F.expr(a), F.expr(b)).alias("value"))


@query(f"WITH {_T} SELECT id, CASE WHEN contains(text, 'Acme') THEN substr(text, greatest(1, instr(text, 'Acme') - 20), instr(text, 'Acme') + 24 - greatest(1, instr(text, 'Acme') - 20)) END AS context FROM t")
def entity_contexts(spark, d):
    return said(spark, d).select("id", tx.with_context(F.col("text"), F.lit("Acme"), 20).alias("context"))
