"""Query analysis, chunking, hash ring, sync, codecs and providers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tarnfold.operators import providers as pv
from tarnfold.operators import querying as qr
from tarnfold.plans.registry import query, table

_WORDS = r"regexp_extract_all(lower(text), '[^ \t\n\r\f\x0b]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in qr.STOPWORDS) + "]"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


@query(f"SELECT doc_id, len(list_filter({_WORDS}, lambda w: NOT list_contains({_STOP}, w) AND length(w) > 2)) AS n_keywords FROM documents")
def keywords(spark, d):
    return _docs(spark, d).select("doc_id", F.size(qr.keywords(F.col("text"))).alias("n_keywords"))


_MAP = "MAP {" + ", ".join(f"'{w}': [" + ", ".join(f"'{x}'" for x in s[:3]) + "]" for w, s in qr.SYNONYMS.items()) + "}"
_Q = "q AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'find ' || c_mktsegment || ' data' WHEN 1 THEN 'Delete user ' || c_name WHEN 2 THEN 'fast ERROR report' ELSE c_name END AS text FROM customer)"


@query(f"WITH {_Q}, w AS (SELECT id, lower(text) AS low, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM q), v AS (SELECT id, i, low, w, unnest(({_MAP})[w]) AS s, generate_subscripts(({_MAP})[w], 1) AS j FROM w WHERE map_contains(({_MAP}), w)) SELECT id, array_to_string(list(replace(low, w, s) ORDER BY i, j)[1:3], '|') AS expanded FROM v GROUP BY id")
def expanded_queries(spark, d):
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('find ', c_mktsegment, ' data') WHEN 1 THEN concat('Delete user ', c_name) WHEN 2 THEN 'fast ERROR report' ELSE c_name END")
    got = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), qr.expanded(text).alias("e"))
    return got.where(F.size("e") > 0).select("id", F.array_join("e", "|").alias("expanded"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS clean FROM documents")
def sanitized_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(qr.sanitized(F.col("text"))).alias("clean"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0b]+') AS w FROM documents)
SELECT doc_id, i AS chunk, md5(array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ')) AS md5 FROM w, range(0, greatest(1, ceil((len(w) - 10) / 40)::BIGINT)) t(i)""")
def text_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(qr.chunked(F.col("text"), 50, 10)).alias("chunk", "c")).select("doc_id", "chunk", F.md5("c").alias("md5"))


@query("SELECT doc_id, len(list_filter(string_split(CASE WHEN doc_id % 3 = 0 THEN 'note' || chr(10) || '[KEY] ' || source || chr(10) || 'IMPORTANT: x' ELSE source END, chr(10)), lambda l: regexp_matches(l, '(?i)' || '" + qr.CRITICAL.replace("'", "''") + "'))) AS n FROM documents")
def critical_lines(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("note\n[KEY] "), "source", F.lit("\nIMPORTANT: x"))).otherwise(F.col("source"))
    return _docs(spark, d).select("doc_id", F.size(qr.critical_lines(t)).alias("n"))


NODES = ["alpha", "beta", "gamma"]
_RING = ", ".join(f"({int(hashlib.md5(f'{n}:{i}'.encode()).hexdigest()[:15], 16)}, '{n}')" for n in NODES for i in range(40))


@query(f"WITH p(pos, node) AS (VALUES {_RING}), k AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 15))::BIGINT AS h FROM customer) SELECT c_custkey, coalesce((SELECT arg_min(node, pos) FROM p WHERE pos > h), (SELECT arg_min(node, pos) FROM p)) AS node FROM k")
def consistent_hash(spark, d):
    return qr.ring_node(table(spark, d, "customer").select("c_custkey"), "c_custkey", qr.ring(spark, NODES, 40))


@query("SELECT o_orderkey AS id, o_orderkey % 5 AS version FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 > 2")
def push_changes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("version"))
    return qr.push_changes(o, o.where("id % 7 <> 0").select("id", F.lit(2).alias("version")))


@query("SELECT p_brand, p_size, round(least(1, max(p_retailprice % 1) + 0.1 * (count(DISTINCT p_type) - 1)), 6) AS confidence, count(DISTINCT p_type) AS sources FROM part GROUP BY ALL")
def corroborated(spark, d):
    facts = table(spark, d, "part").select("p_brand", "p_size", (F.col("p_retailprice") % 1).alias("confidence"), F.col("p_type").alias("source"))
    return qr.boosted_by_sources(facts, ["p_brand", "p_size"]).withColumn("confidence", F.round("confidence", 6))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 10")
def consolidation_groups(spark, d):
    return qr.consolidation_groups(table(spark, d, "events"), "user_id", "value", "event_id").select("event_id", "user_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, md5(text) AS text_md5, true AS intact FROM documents")
def codec_roundtrip(spark, d):
    packed = pv.compress(_docs(spark, d), "doc_id", "text")
    return pv.decompress(packed, "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "intact")


@query("SELECT doc_id, round(len(list_filter(['the', 'than', 'of'], lambda q: list_contains(list_distinct(" + _WORDS + "), q))) / 3, 6) AS rerank_score FROM documents ORDER BY rerank_score DESC, doc_id LIMIT 10")
def rerank(spark, d):
    return pv.rerank(_docs(spark, d), "the than of", 10).withColumn("rerank_score", F.round("rerank_score", 6))


@query("SELECT doc_id, true AS unit FROM documents")
def embed_all(spark, d):
    got = pv.embed_all(_docs(spark, d).select("doc_id", "text"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return got.select("doc_id", ((F.abs(norm - 1) < 1e-9) | (norm == 0)).alias("unit"))


_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with(q, '{s}')" for s in starts) + f" THEN '{kind}'" for kind, starts in qr.rl.QUERY_STARTS) + " ELSE 'exploratory' END"


@query(f"SELECT id, {_KIND} AS kind FROM (SELECT c_custkey AS id, lower(CASE c_custkey % 5 WHEN 0 THEN 'How many in ' WHEN 1 THEN 'Show me ' WHEN 2 THEN 'who is ' WHEN 3 THEN 'explain ' ELSE 'about ' END || c_name) AS q FROM customer)")
def query_kinds(spark, d):
    q = F.expr("concat(CASE c_custkey % 5 WHEN 0 THEN 'How many in ' WHEN 1 THEN 'Show me ' WHEN 2 THEN 'who is ' WHEN 3 THEN 'explain ' ELSE 'about ' END, c_name)")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), qr.query_kind(q).alias("kind"))


@query("SELECT event_id FROM events WHERE (event_type = 'click' AND user_id > 50) OR (event_type = 'view' AND user_id > 20) OR (event_type NOT IN ('click', 'view') AND user_id > 0) ORDER BY event_id LIMIT 100")
def events_since_clock(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map("event_type", "user_id").alias("clock"))
    return qr.events_since(e, F.col("clock"), {"click": 50, "view": 20}).select("event_id")
