"""Queries on a stored index: full-text language, batches of queries, and the retrieval benchmark."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators import dense, providers
from tarnfold.operators import fulltext as ft
from tarnfold.operators import retrieval as rt
from tarnfold.plans.registry import query, table
from tarnfold.plans.search import _rounded
from tarnfold.session import checkpoint_dir, cut

FOLDED = ft.Analyzer(porter=False)
#: (columns, analyzer, k1)
KINDS = {"folded": (("text", "source"), FOLDED, 1.2), "porter": (("text", "source"), ft.PORTER, 1.2), "plain": (("text",), ft.PLAIN, 1.5)}


@lru_cache(maxsize=64)
def _written(app: str, sf_dir: str, changed: tuple, kind: str) -> str:
    spark = SparkSession.getActiveSession()
    columns, analyzer, k1 = KINDS[kind]
    return ft.build(table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", columns, "doc_id", analyzer, k1).path


def stored(spark: SparkSession, sf_dir: str, kind: str) -> ft.Index:
    """The index of a documents table, written once an application and again where the table's files changed."""
    jvm, at = spark.sparkContext._jvm, f"{sf_dir}/documents.parquet"
    path = jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    changed = tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))
    return ft.opened(spark, _written(spark.sparkContext.applicationId, sf_dir, changed, kind))


# ---------------------------------------------------------------- one query, with the SQL of the same result

_W = r"regexp_extract_all(translate(lower(strip_accents(coalesce(X, ''))), '_', ' '), '[\p{L}\p{N}]+')"
_WORDS = f"t AS (SELECT doc_id, {_W.replace('X', 'text')} AS w0, {_W.replace('X', 'source')} AS w1 FROM documents)"


def _count(p: ft.Phrase) -> str:
    """Places of a phrase in the columns it may stand in."""

    def at(w: str) -> str:
        same = [f"{w}[i + {j}] = '{t}'" if not (p.prefix and j == len(p.terms) - 1) else f"starts_with({w}[i + {j}], '{t}')" for j, t in enumerate(p.terms)]
        return f"len(list_filter(range(1, len({w}) - {len(p.terms)} + 2), lambda i: {' AND '.join(same)}))"

    return " + ".join(at(f"w{i}") for i, c in enumerate(("text", "source")) if p.columns is None or c in p.columns)


def _where(tree: ft.Node | ft.Phrase, order: list[ft.Phrase]) -> str:
    if isinstance(tree, ft.Phrase):
        return f"f{order.index(tree)} > 0"
    parts = [f"({_where(p, order)})" for p in tree.parts]
    return f"{parts[0]} AND NOT {parts[1]}" if tree.kind == "not" else f" {tree.kind.upper()} ".join(parts)


def _counting(tree: ft.Node | ft.Phrase, order: list[ft.Phrase], inside: str = "true") -> dict[int, str]:
    here = f"({inside}) AND ({_where(tree, order)})"
    if isinstance(tree, ft.Phrase):
        return {order.index(tree): here}
    out: dict[int, str] = {}
    for part in tree.parts[:1] if tree.kind == "not" else tree.parts:
        for i, c in _counting(part, order, here).items():
            out[i] = f"({out[i]}) OR ({c})" if i in out else c
    return out


def _sql(text: str, k: int) -> str:
    tree = ft.parse(text, FOLDED, ("text", "source"))
    order = ft.phrases(tree)
    counts = ", ".join(f"{_count(p)} AS f{i}" for i, p in enumerate(order))
    docs = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(order)))
    idf = lambda i: f"CASE WHEN n - d{i} > d{i} THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 0.000001 END"
    parts = " + ".join(f"CASE WHEN {c} THEN ({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean)) ELSE 0 END" for i, c in _counting(tree, order).items())
    return f"""WITH {_WORDS}, c AS (SELECT doc_id, len(w0) + len(w1) AS dl, {counts} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS mean, {docs} FROM c)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {parts} AS score FROM c, s WHERE {_where(tree, order)} ORDER BY score DESC, doc_id LIMIT {k})"""


def _search(name: str, text: str, k: int = 1000):
    @query(_sql(text, k), name=name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(ft.search(spark, stored(spark, d, "folded"), text, k), "score")


@query(f"WITH {_WORDS}, u AS (SELECT doc_id, unnest(list_concat(w0, w1)) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM u GROUP BY term")
def fts_index(spark, d):
    return stored(spark, d, "folded").terms(spark)


_search("fts_boolean", "(whou OR ouier) AND (the OR le) NOT tion")
_search("fts_phrase", '"of the" OR "de la" OR in + and')
_search("fts_prefix", 'erth* AND "of th" *')
_search("fts_column", "source : src3 AND (the OR le OR die)")
_search("fts_nested", "the AND (whou OR (of AND NOTHING)) OR (le AND la) NOT des")


@query()
def fts_stemmed(spark, d):
    """Stemmed words; held against SQLite's FTS5 in the tests."""
    return _rounded(ft.search(spark, stored(spark, d, "porter"), "(reading OR tions) NOT things", None), "score")


# ---------------------------------------------------------------- a table of queries

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BATCH = rf"""
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, len({_TOK}) AS dl FROM documents), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM (SELECT coalesce(dl, 0) AS dl FROM l)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(times * greatest(0.25, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 9) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (doc_id), st GROUP BY ALL))"""


def _items(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark, d, k: int) -> DataFrame:
    index = stored(spark, d, "plain")
    return ft.batch_top_k(spark, index, ft.asked(_items(spark, d), index.analyzer), k).withColumnRenamed("key", "doc_id")


@query(f"WITH {_BATCH} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM lx WHERE rank <= 10")
def batch_bm25(spark, d):
    """Every benchmark text as a query."""
    return _rounded(_lexical(spark, d, 10), "score")


_NORM = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END"


@query(f"""WITH {_BATCH},
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
sx AS (SELECT item_id AS query_id, e.vec_id AS doc_id, list_dot_product(e.v, o.v) / (e.n * o.n) AS score FROM benchmark JOIN e o ON o.vec_id = item_id, e QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, e.vec_id) <= 30),
lr AS (SELECT query_id, doc_id, rank - 1 AS rl, {_NORM} AS nl FROM (SELECT * FROM lx WHERE rank <= 30) WINDOW w AS (PARTITION BY query_id)),
sr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rs, {_NORM} AS ns FROM sx WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, 0.4 * (coalesce(1 / (60 + rl + 1), 0) + coalesce(nl, 0)) + 0.6 * (coalesce(1 / (60 + rs + 1), 0) + coalesce(ns, 0)) AS score,
  CASE WHEN rl IS NOT NULL AND rs IS NOT NULL THEN 'hybrid' WHEN rl IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS source FROM lr FULL JOIN sr USING (query_id, doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 10""")
def batch_hybrid_search(spark, d):
    """Benchmark texts by BM25, with the embedding of the same id by cosine; 30 candidates of each, fused, the best 10."""
    e = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
    semantic = dense.batch_top_k(e, asked, 30).withColumnRenamed("vec_id", "doc_id")
    return _rounded(hybrid(_lexical(spark, d, 30), semantic), "score")


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int = 10) -> DataFrame:
    fused = rt.fuse(cut(lexical), cut(semantic), "store", 0.4, 0.6, by=("query_id",))
    return rt.with_ranks(fused, by=("query_id",)).withColumn("rank", F.col("rank0") + 1).where(F.col("rank") <= k).drop("rank0")


_HOLDS = rf"b AS (SELECT item_id AS query_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS p FROM benchmark), t AS (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS t FROM documents), truth AS (SELECT query_id, doc_id FROM b JOIN t ON contains(t, p) WHERE trim(p) <> '')"


@query(f"WITH {_HOLDS} SELECT query_id, doc_id FROM truth")
def batch_phrases(spark, d):
    """Documents that hold each benchmark text word for word."""
    return _truth(spark, d)


def _truth(spark, d) -> DataFrame:
    return ft.batch_phrases(spark, stored(spark, d, "plain"), _items(spark, d)).select("query_id", F.col("key").alias("doc_id"))


def recalls(ranked: DataFrame, truth: DataFrame, method: str, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: share of queries with a document of theirs among the first k, and the mean of 1 / rank of the first one, over
    queries that have one at all."""
    first = ranked.join(truth, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    per = truth.select("query_id").distinct().join(first, "query_id", "left")
    shares = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in at]
    return per.agg(F.count("*").alias("queries"), *shares, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr")).select(F.lit(method).alias("method"), "*")


@query(f"""WITH {_BATCH}, {_HOLDS},
r AS (SELECT query_id, min(rank) AS first FROM lx JOIN truth USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id), a AS (SELECT * FROM (SELECT DISTINCT query_id FROM truth) LEFT JOIN r USING (query_id))
SELECT 'bm25' AS method, count(*) AS queries, {', '.join(f'round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}' for k in (1, 3, 5, 10))}, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM a""")
def retrieval_benchmark(spark, d):
    """Benchmark texts as queries; documents that hold them word for word are the truth."""
    return recalls(_lexical(spark, d, 10), _truth(spark, d), "bm25")


@query()
def retrieval_benchmark_methods(spark, d):
    """The same by BM25, by hashed-word vectors, and by both fused. The vectors are the built-in stand-in for a model."""
    truth = cut(_truth(spark, d))
    lexical = cut(_lexical(spark, d, 30))
    vectors = providers.embed_all(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")).select("vec_id", "embedding")
    with ft.few_rows(spark):
        semantic = cut(dense.batch_top_k(vectors, providers.embed_all(_items(spark, d)), 30).withColumnRenamed("vec_id", "doc_id"))
    lists = (("bm25", lexical.where("rank <= 10")), ("vector", semantic.where("rank <= 10")), ("hybrid", hybrid(lexical, semantic)))
    return recalls(lists[0][1], truth, "bm25").unionByName(recalls(lists[1][1], truth, "vector")).unionByName(recalls(lists[2][1], truth, "hybrid"))
