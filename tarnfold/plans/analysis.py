"""Filters, facets and analytics over documents, events and labels."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tarnfold.functions import text as tx
from tarnfold.operators import analytics as an
from tarnfold.operators import filters as fl
from tarnfold.plans.registry import query, table


def _docs(spark, d):
    return table(spark, d, "documents")


def _filter(name: str, sql: str, field: str, op: str, value=None, tab: str = "documents", key: str = "doc_id", **how):
    @query(f"SELECT {key} FROM {tab} WHERE {sql}", name=f"filter_{name}")
    def run(spark, d):
        df = table(spark, d, tab)
        return df.where(fl.FilterBuilder(df).where(field, op, value, **how).build()).select(key)


_filter("equals", "lang = 'fr'", "lang", "eq", "fr")
_filter("equals_nocase", "lower(source) = 'src3'", "source", "eq", "SRC3", case_sensitive=False)
_filter("not_equals", "lang <> 'en'", "lang", "ne", "en")
_filter("contains", "contains(text, 'tion')", "text", "contains", "tion")
_filter("not_contains", "NOT contains(text, 'the')", "text", "not_contains", "the")
_filter("starts_with", "starts_with(text, 'Th')", "text", "starts_with", "Th")
_filter("ends_with", "ends_with(text, '.')", "text", "ends_with", ".")
_filter("regex", "regexp_matches(text, '[0-9]{3}')", "text", "regex", "[0-9]{3}")
_filter("in", "source IN ('src1', 'src4')", "source", "in", ["src1", "src4"])
_filter("not_in", "source NOT IN ('src1', 'src4')", "source", "not_in", ["src1", "src4"])
_filter("greater", "value > 50", "value", "gt", 50.0, "events", "event_id")
_filter("at_most", "value <= 10", "value", "lte", 10.0, "events", "event_id")
_filter("between", "value BETWEEN 20 AND 30", "value", "between", (20.0, 30.0), "events", "event_id")
_filter("date_range", "ts BETWEEN '2024-01-05' AND '2024-01-08'", "ts", "between", (datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 8)), "events", "event_id")
_filter("exists", "props IS NOT NULL", "props", "exists", None, "events", "event_id")


@query("SELECT doc_id FROM documents WHERE n_chars >= 500 AND (lang = 'de' OR source = 'src2') AND NOT (source = 'src5')")
def filter_groups(spark, d):
    df = _docs(spark, d)
    built = fl.FilterBuilder(df).at_least("n_chars", 500).any_group().equals("lang", "de").equals("source", "src2").end().not_group().equals("source", "src5").end().build()
    return df.where(built).select("doc_id")


@query("""SELECT doc_id FROM (SELECT *, [lang, source] AS tags, (doc_id % 100) / 100 AS confidence, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at FROM documents)
WHERE (list_contains(tags, 'fr') OR list_contains(tags, 'src1')) AND confidence >= 0.25 AND created_at >= '2024-01-03'""")
def filter_common(spark, d):
    rows = memories(spark, d)
    return rows.where(fl.common_filter(["fr", "src1"], None, 0.25, datetime.datetime(2024, 1, 3))).select("doc_id")


def memories(spark, d):
    """Documents as memories: tags, confidence and creation time from columns."""
    return _docs(spark, d).select(
        "doc_id", F.col("text").alias("content"), "source", "lang", F.array("lang", "source").alias("tags"), ((F.col("doc_id") % 100) / 100).alias("confidence"),
        (F.lit(datetime.datetime(2024, 1, 1)) + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("created_at"), (F.col("doc_id") % 7 == 0).alias("is_deleted"),
    )


MEMORIES = "m AS (SELECT doc_id, text AS content, source, lang, [lang, source] AS tags, (doc_id % 100) / 100 AS confidence, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at, doc_id % 7 = 0 AS is_deleted FROM documents)"


@query("SELECT source AS value, count(*) AS count FROM documents GROUP BY source HAVING count(*) >= 2 ORDER BY count DESC, value LIMIT 10")
def facet_terms(spark, d):
    return an.terms_facet(_docs(spark, d), "source", 2, 10)


@query(f"WITH {MEMORIES} SELECT value, count(*) AS count FROM (SELECT unnest(tags) AS value FROM m) GROUP BY value ORDER BY count DESC, value LIMIT 100")
def facet_tags(spark, d):
    return an.terms_facet(memories(spark, d), "tags")


def _dates(size: str, fmt: str):
    @query(f"SELECT strftime(date_trunc('{size}', ts), '{fmt}') AS bucket, count(*) AS count FROM events GROUP BY 1", name=f"facet_date_{size}")
    def run(spark, d):
        return an.date_facet(table(spark, d, "events"), "ts", size)


for _size, _fmt in {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "week": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}.items():
    _dates(_size, _fmt)


@query("""WITH e AS (SELECT min(value) AS low, (max(value) - min(value)) / 5 AS w FROM events)
SELECT i::INT AS i, printf('%.2f-%.2f', low + i * w, low + (i + 1) * w) AS label, count(*) AS count FROM (SELECT least(floor((value - low) / w), 4) AS i, low, w FROM events, e) GROUP BY i, low, w""")
def facet_range(spark, d):
    return an.range_facet(table(spark, d, "events"), "value", 5)


@query("""SELECT facet, value, count FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS n FROM (
SELECT facet, value, count(*) AS count FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY facet, value)) WHERE n <= 3""")
def filter_suggestions(spark, d):
    return an.filter_suggestions(_docs(spark, d), ["lang", "source"], 3)


@query(f"WITH {MEMORIES} SELECT count(*) FILTER (NOT is_deleted) AS active, count(*) FILTER (is_deleted) AS deleted, round(avg(length(content)) FILTER (NOT is_deleted), 6) AS avg_length, min(created_at) FILTER (NOT is_deleted) AS first_at, max(created_at) FILTER (NOT is_deleted) AS last_at FROM m")
def memory_stats(spark, d):
    return an.memory_stats(memories(spark, d)).withColumn("avg_length", F.round("avg_length", 6))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY 1")
def daily_counts(spark, d):
    return an.daily_counts(table(spark, d, "events"), "ts", datetime.datetime(2024, 1, 30), 7)


@query("SELECT coalesce(json_extract_string(props, '$.k'), 'unknown') AS domain, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM events GROUP BY 1")
def domain_distribution(spark, d):
    got = table(spark, d, "events").groupBy(F.coalesce(F.get_json_object("props", "$.k"), F.lit("unknown")).alias("domain")).agg(F.count("*").alias("count"))
    return an.with_share(got).withColumn("percentage", F.round("percentage", 6))


@query("SELECT lower(trim(event_type)) AS query, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY GROUP BY 1 ORDER BY n DESC, query LIMIT 3")
def search_trends(spark, d):
    return an.search_trends(table(spark, d, "events"), "event_type", "ts", datetime.datetime(2024, 1, 30), 10, 3)


@query("SELECT o_orderstatus AS branch, count(*) AS memories, count(DISTINCT o_custkey) AS ids, max(o_orderdate) AS last_commit FROM orders GROUP BY 1")
def branch_comparison(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("branch")).agg(F.count("*").alias("memories"), F.countDistinct("o_custkey").alias("ids"), F.max("o_orderdate").alias("last_commit"))


@query("""SELECT event_type, le, count(*) FILTER (ok) AS count FROM (SELECT event_type, b.le, (b.bound IS NULL OR value <= b.bound) AS ok FROM events, (VALUES ('1.0', 1.0), ('10.0', 10.0), ('50.0', 50.0), ('+Inf', NULL)) b(le, bound)) GROUP BY event_type, le""")
def histogram_buckets(spark, d):
    return an.cumulative_histogram(table(spark, d, "events"), "value", [1.0, 10.0, 50.0], ["event_type"])


@query("SELECT event_type, user_id % 3 AS shard, round(sum(value), 4) AS total, count(*) AS n, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2")
def counter_by_label(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("shard")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, round(sum(value) / 300, 6) AS rate FROM events GROUP BY 1")
def rate_5m(spark, d):
    got = table(spark, d, "events").groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value") / 300, 6).alias("rate"))
    return got.select(F.col("w.start").alias("start"), "n", "rate")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_quantiles(spark, d):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return table(spark, d, "events").groupBy("event_type").agg(p.alias("p")).select("event_type", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


@query("""SELECT source, count(*) AS total, count(*) FILTER (quality = 0) AS rejected, round((0.6 + greatest(0, 1 - 2 * count(*) FILTER (quality = 0) / count(*))) / 2, 6) AS reliability, count(*) >= 10 AND count(*) FILTER (quality = 0) / count(*) > 0.5 AS suspicious
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def source_reliability(spark, d):
    rows = _docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return an.source_reliability(rows, "source", F.col("quality") == 0, F.lit(0.6)).withColumn("reliability", F.round("reliability", 6))


@query("""SELECT count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days, count(DISTINCT strftime(ts, '%G-W%V')) AS weeks, count(DISTINCT strftime(ts, '%Y-%m')) AS months, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events""")
def timeline_stats(spark, d):
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return table(spark, d, "events").agg(F.countDistinct(F.date_format("ts", "yyyy-MM-dd")).alias("days"), F.countDistinct(week).alias("weeks"), F.countDistinct(F.date_format("ts", "yyyy-MM")).alias("months"), F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("SELECT sum(strlen(text))::BIGINT AS content_bytes, count(*) AS rows, (SELECT count(embedding) * 64 * 4 FROM embeddings) AS vector_bytes FROM documents")
def storage_metrics(spark, d):
    vectors = table(spark, d, "embeddings").agg((F.count("embedding") * 64 * 4).alias("vector_bytes"))
    return _docs(spark, d).agg(F.sum(F.octet_length("text")).alias("content_bytes"), F.count("*").alias("rows")).crossJoin(F.broadcast(vectors))


@query(r"""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / length(text) END, 6) AS special, round(len(list_distinct(w)) / len(w), 6) AS repetition, length(text) > 5000 OR len(w) > 500 AS long, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) AS sentences
FROM (SELECT *, regexp_extract_all(lower(text), '[^ \t\n\r\f\x0b]+') AS w FROM documents)""")
def content_heuristics(spark, d):
    t = F.col("text")
    n_words = F.regexp_count(t, F.lit(r"\S+"))
    return _docs(spark, d).select("doc_id", F.round(tx.special_ratio(t), 6).alias("special"), F.round(tx.repetition(t), 6).alias("repetition"), ((F.length(t) > 5000) | (n_words > 500)).alias("long"), F.size(tx.sentences(t)).alias("sentences"))


@query(r"""SELECT doc_id, substr(sha256('doc:' || doc_id || ':' || source), 1, 16) AS id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content_hash, (('0x' || right(md5(source), 12))::BIGINT % 16)::INT AS shard FROM documents""")
def deterministic_ids(spark, d):
    return _docs(spark, d).select("doc_id", tx.short_id(F.lit("doc"), F.col("doc_id").cast("string"), F.col("source")).alias("id"), tx.content_hash(F.col("text")).alias("content_hash"), tx.shard(F.col("source"), 16).alias("shard"))


@query("SELECT 'events_total{event_type=\"' || event_type || '\",shard=\"' || (user_id % 3) || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 3")
def prometheus_export(spark, d):
    got = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("shard")).agg(F.count("*").alias("n"))
    return an.prometheus_text(got, "events_total", ["event_type", "shard"], "n")


@query("SELECT event_type AS kind, CASE WHEN value > 80 THEN 'critical' WHEN value > 40 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY ALL")
def audit_summary(spark, d):
    return an.audit_summary(table(spark, d, "events"), "event_type", F.when(F.col("value") > 80, "critical").when(F.col("value") > 40, "warning").otherwise("info"))


@query("SELECT event_type, count(*) FILTER (value > 30) AS hits, count(*) FILTER (value <= 30) AS misses, round(count(*) FILTER (value > 30) / count(*), 6) AS ratio FROM events GROUP BY event_type")
def cache_hit_ratio(spark, d):
    return an.hit_ratio(table(spark, d, "events"), "event_type", F.col("value") > 30).withColumn("ratio", F.round("ratio", 6))
