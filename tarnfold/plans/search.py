"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators import dense
from tarnfold.operators import retrieval as rt
from tarnfold.plans.registry import query, table

TERMS = ["the", "than", "and", "the"]

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BM25 = rf"""
tok AS (SELECT doc_id, {_TOK} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
q AS (SELECT unnest(['the','than','and']) AS term, unnest([2,1,1]) AS times),
tf AS (SELECT doc_id, len(w) AS dl, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM tok, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN times * greatest(0.25, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * (K1 + 1) / (tf + K1 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END) AS score
       FROM tf JOIN df USING (term), st GROUP BY doc_id)"""
BM25, FTS = _BM25.replace("K1", "1.5::DOUBLE"), _BM25.replace("K1", "1.2::DOUBLE")
_VEC = """
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
vs AS (SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], q) AS dot, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, sqrt(list_dot_product(q, q)) AS nq,
       list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM embeddings, qv)"""
_LISTS = f"""WITH {BM25}, {_VEC},
lx AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 30),
sx AS (SELECT doc_id, dot / (n * nq) AS score FROM vs ORDER BY score DESC, doc_id LIMIT 30),
lr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rl, NORM AS nl FROM lx),
sr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rs, NORM AS ns FROM sx),
f AS (SELECT doc_id, rl, nl, rs, ns FROM lr FULL JOIN sr USING (doc_id))
SELECT doc_id, round(FUSED, 6) AS score, CASE WHEN rl IS NOT NULL AND rs IS NOT NULL THEN 'hybrid' WHEN rl IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS source FROM f"""
_MINMAX = "CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 0.5 END"
_ZSCORE = "CASE WHEN stddev_pop(score) OVER () > 0 THEN 1 / (1 + exp(-(score - avg(score) OVER ()) / stddev_pop(score) OVER ())) ELSE 0.5 END"
_PERCENT = "CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY score, doc_id) - 1) / (count(*) OVER () - 1) ELSE 0.5 END"
_RRF = "0.5 * coalesce(1 / (60 + rl + 1), 0) + 0.5 * coalesce(1 / (60 + rs + 1), 0)"
_LINEAR = "0.5 * coalesce(nl, 0) + 0.5 * coalesce(ns, 0)"
_STORE = "0.4 * (coalesce(1 / (60 + rl + 1), 0) + coalesce(nl, 0)) + 0.6 * (coalesce(1 / (60 + rs + 1), 0) + coalesce(ns, 0))"


def _sql(norm: str, fused: str) -> str:
    return _LISTS.replace("NORM", norm).replace("FUSED", fused)


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    lexical = rt.bm25_top_k(_docs(spark, d), TERMS, 30)
    semantic = rt.top_k(rt.vector_scores_by_id(table(spark, d, "embeddings"), 0), 30, "vec_id").withColumnRenamed("vec_id", "doc_id")
    return lexical, semantic


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(rf"""WITH t AS (SELECT unnest(list_distinct({_TOK})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(greatest(0.25, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1)), 6) AS idf FROM t, n GROUP BY term""")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rt.bm25_idf(_docs(spark, d)), "idf")


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return _rounded(rt.bm25_top_k(_docs(spark, d), TERMS, 10), "score")


@query(f"WITH {FTS} SELECT doc_id, round(score, 6) AS score FROM bm WHERE doc_id IN (SELECT doc_id FROM tf GROUP BY doc_id HAVING min(tf) > 0) ORDER BY bm.score DESC, doc_id LIMIT 20")
def fts_search(spark, d):
    return _rounded(rt.fts_search(_docs(spark, d), TERMS, 20), "score")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion on') ORDER BY doc_id LIMIT 25")
def substring_search(spark, d):
    return rt.substring_search(_docs(spark, d), "tion ON", 25).select("doc_id")


def _vector(metric: str, expr: str):
    @query(f"WITH {_VEC.strip()} SELECT doc_id AS vec_id, round({expr}, 6) AS score FROM vs ORDER BY {expr} DESC, doc_id LIMIT 10", name=f"vector_topk_{metric}")
    def run(spark, d):
        return _rounded(rt.top_k(rt.vector_scores_by_id(table(spark, d, "embeddings"), 0, metric), 10, "vec_id"), "score")


_vector("cosine", "dot / (n * nq)")
_vector("dot", "dot")
_vector("euclidean", "1 / (1 + sqrt(d2))")


@query(f"WITH {_VEC.strip()} SELECT doc_id AS vec_id, round(dot / (n * nq), 6) AS score FROM vs WHERE doc_id NOT IN (0, 1, 2) ORDER BY dot / (n * nq) DESC, doc_id LIMIT 10")
def find_similar(spark, d):
    return _rounded(rt.find_similar(table(spark, d, "embeddings"), 0, [0, 1, 2]), "score")


def _fusion(name: str, strategy: str, norm: str, fused: str, method: str = "minmax", weights=(0.5, 0.5)):
    @query(_sql(norm, fused), name=name)
    def run(spark, d):
        return _rounded(rt.fuse(*_lists(spark, d), strategy, *weights, method=method), "score")


_fusion("fuse_rrf", "rrf", _MINMAX, _RRF)
_fusion("fuse_linear_minmax", "linear", _MINMAX, _LINEAR)
_fusion("fuse_linear_zscore", "linear", _ZSCORE, _LINEAR, "zscore")
_fusion("fuse_linear_percentile", "linear", _PERCENT, _LINEAR, "percentile")
_fusion("fuse_distribution", "distribution", _PERCENT, f"CASE WHEN coalesce(nl, 0) > 0 AND coalesce(ns, 0) > 0 THEN pow(nl, 0.5) * pow(ns, 0.5) ELSE {_LINEAR} END")
_fusion("fuse_max", "max", _MINMAX, "greatest(coalesce(nl, 0), coalesce(ns, 0))")
_fusion("store_hybrid_all", "store", _MINMAX, _STORE, weights=(0.4, 0.6))


@query(f"SELECT doc_id, score, source FROM ({_sql(_MINMAX, _STORE)}) ORDER BY score DESC, doc_id LIMIT 10")
def hybrid_search(spark, d):
    return _rounded(rt.hybrid_search(_docs(spark, d), table(spark, d, "embeddings"), TERMS, 0), "score")


@query(f"""WITH {BM25}, {_VEC},
l1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 0.5 AS w FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 30)),
l2 AS (SELECT doc_id, row_number() OVER (ORDER BY dot / (n * nq) DESC, doc_id) AS r, 0.25 AS w FROM (SELECT * FROM vs ORDER BY dot / (n * nq) DESC, doc_id LIMIT 30)),
l3 AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, 0.25 AS w FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30))
SELECT doc_id, round(sum(w / (60 + r)), 6) AS score, count(*) AS n_lists FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY doc_id""")
def rrf_n_lists(spark, d):
    length = rt.top_k(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")), 30, "doc_id")
    return _rounded(rt.fuse_rankings([*_lists(spark, d), length], [2.0, 1.0, 1.0]), "score")


_METRICS = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
r AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, (e.label = q.label)::INT AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.v, q.v) / (e.n * q.n) DESC, e.vec_id) AS rank
      FROM e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM r WHERE rank <= 20),
w AS (SELECT query_id, sum(rel) AS n_rel FROM r GROUP BY query_id),
p AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1.0) END) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN rel END) AS at_k, sum(CASE WHEN rel = 1 THEN found / rank END) AS ap FROM h GROUP BY query_id)
SELECT query_id, round(dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, least(n_rel, 10)::BIGINT + 1) t(i)), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr, round(at_k / 10, 6) AS precision, round(at_k / n_rel, 6) AS recall, round(coalesce(ap, 0) / n_rel, 6) AS average_precision
FROM p JOIN w USING (query_id)"""


def _nearest(spark, d) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, rank, label, ql) of the 20 nearest, and the queries: ids divisible by 50, against all rows."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"), "embedding")
    ranked = dense.batch_top_k(e, q, 20, apart=True).join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", "ql"), "query_id")
    return ranked.select("query_id", F.col("vec_id").alias("doc_id"), "rank", "label", "ql"), q.select("query_id", "ql")


@query(f"WITH {_METRICS}")
def ranking_metrics(spark, d):
    """Rows of the query's label are relevant: as many as the label has, less the query."""
    ranked, q = _nearest(spark, d)
    labels = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    wanted = q.join(labels, F.col("ql") == F.col("label")).select("query_id", F.lit(1).alias("grade"), (F.col("n") - 1).alias("n"))
    hits = ranked.select("query_id", "rank", (F.col("label") == F.col("ql")).cast("int").alias("rel"))
    return _rounded(rt.metrics(hits, wanted), "ndcg", "mrr", "precision", "recall", "average_precision")


_GRADE = "CASE WHEN e.label = q.label THEN 2 WHEN abs(e.label - q.label) = 1 THEN 1 ELSE 0 END"


@query(f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
r AS (SELECT q.vec_id AS query_id, {_GRADE} AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.v, q.v) / (e.n * q.n) DESC, e.vec_id) AS rank,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {_GRADE} DESC) AS ideal FROM e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN (pow(2, rel) - 1) / log2(rank + 1.0) END) / sum(CASE WHEN ideal <= 10 THEN (pow(2, rel) - 1) / log2(ideal + 1.0) END), 6) AS ndcg
FROM r GROUP BY query_id""")
def ndcg_graded(spark, d):
    """Rows of the query's label have grade 2, those of the next labels grade 1."""
    ranked, q = _nearest(spark, d)
    labels = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    near = q.select("query_id", "ql", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")).withColumn("label", F.col("ql") + F.col("step"))
    wanted = near.join(labels, "label").groupBy("query_id", F.when(F.col("step") == 0, 2).otherwise(1).alias("grade")).agg(F.sum(F.col("n") - (F.col("step") == 0).cast("int")).alias("n"))
    hits = ranked.select("query_id", "rank", F.when(F.col("label") == F.col("ql"), 2).when(F.abs(F.col("label") - F.col("ql")) == 1, 1).otherwise(0).alias("rel"))
    return _rounded(rt.metrics(hits, wanted).select("query_id", "ndcg"), "ndcg")


@query(f"""WITH RECURSIVE {_VEC.strip()},
c AS (SELECT doc_id, dot / (n * nq) AS score FROM vs ORDER BY score DESC, doc_id LIMIT 50), l AS (SELECT min(score) AS lo, max(score) AS hi FROM c),
x AS (SELECT doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END AS rel FROM c, l),
e AS (SELECT x.doc_id, v.embedding::DOUBLE[] AS v, sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS n FROM x JOIN embeddings v ON v.vec_id = x.doc_id),
near AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS s FROM e a, e b),
f AS (SELECT 1 AS rank, [doc_id] AS picked, 0.7 * rel AS mmr FROM (SELECT doc_id, rel FROM x ORDER BY 0.7 * rel DESC, doc_id LIMIT 1)
UNION ALL SELECT rank + 1, list_append(picked, doc_id), value FROM (SELECT f.rank, f.picked, x.doc_id, 0.7 * x.rel - 0.3 * greatest(0, (SELECT max(s) FROM near WHERE near.a = x.doc_id AND list_contains(f.picked, near.b))) AS value,
  row_number() OVER (ORDER BY 0.7 * x.rel - 0.3 * greatest(0, (SELECT max(s) FROM near WHERE near.a = x.doc_id AND list_contains(f.picked, near.b))) DESC, x.doc_id) AS r FROM f, x WHERE rank < 10 AND NOT list_contains(f.picked, x.doc_id)) WHERE r = 1)
SELECT 0 AS query_id, rank::INT AS rank, picked[rank] AS doc_id, round(mmr, 6) AS mmr FROM f""")
def mmr_topk(spark, d):
    e = table(spark, d, "embeddings")
    near = rt.top_k(rt.vector_scores_by_id(e, 0), 50, "vec_id").join(e.select("vec_id", "embedding"), "vec_id")
    return _rounded(rt.mmr(near.select(F.lit(0).alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "embedding"), 10), "mmr")


@query("""WITH q AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3), c AS (SELECT vec_id % 50 AS doc_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, q_id, max(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)))) AS s FROM q, c GROUP BY doc_id, q_id) GROUP BY doc_id""")
def max_sim(spark, d):
    e = table(spark, d, "embeddings")
    return _rounded(rt.max_sim(e.where("vec_id < 3").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), e.select((F.col("vec_id") % 50).alias("doc_id"), F.col("embedding").alias("d"))), "score")


@query("SELECT vec_id, round(1 / (1 + exp(-2.0 * label - -5.0)), 6) AS platt, CASE WHEN label <= 2 THEN 0.1 WHEN label <= 6 THEN round(0.1 + (label - 2) * 0.15, 6) ELSE 0.7 END AS isotonic FROM embeddings")
def calibrated_scores(spark, d):
    s = F.col("label").cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(rt.platt(s, 2.0, -5.0), 6).alias("platt"), F.round(rt.isotonic_apply(s, [2.0, 6.0], [0.1, 0.7]), 6).alias("isotonic"))
