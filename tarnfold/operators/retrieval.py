"""Lexical and vector retrieval, score normalisation, fusion, diversification and ranking metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.functions import text as tx
from tarnfold.functions import vector as vx
from tarnfold.session import cut

# ---------------------------------------------------------------- BM25


def bm25_idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf) of every term: max(0.25, ln((N - df + 0.5) / (df + 0.5) + 1))."""
    n = docs.agg(F.count("*").alias("n"))
    terms = docs.select(F.explode(F.array_distinct(tx.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.crossJoin(F.broadcast(n)).select("term", "df", F.greatest(F.lit(0.25), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("idf"))


def term_counts(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, tf0, tf1, ...): words of each document, and how many of them are each term. Texts are read once: what is
    written down is a few numbers a document. A text that doesn't hold a term at all is not searched for it."""
    low, edge = F.lower(text), r"[\p{L}\p{N}_]"
    tf = lambda t: F.when(F.contains(low, F.lit(t)), F.regexp_count(low, F.lit(rf"(?<!{edge})\Q{t}\E(?!{edge})"))).otherwise(0)
    return cut(docs.select(key, F.coalesce(F.regexp_count(low, F.lit(tx.WORDS)), F.lit(0)).alias("dl"), *[F.coalesce(tf(t), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)]))


def bm25_scores(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, every: bool = False) -> DataFrame:
    """(key, score) of every document, or with ``every`` of those that have all terms; repeated query terms count each time.
    Corpus statistics are one aggregate row; no postings are shuffled for a query."""
    terms = sorted(set(query))
    rows = term_counts(docs, terms, key, text)
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score, all_ = F.lit(0.0), F.lit(True)
    for i, t in enumerate(terms):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(0.25), F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1))
        part = F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
        score, all_ = score + query.count(t) * part, all_ & (tf > 0)
    scored = rows.crossJoin(F.broadcast(stats))
    return (scored.where(all_) if every else scored).select(key, score.alias("score"))


def top_k(scored: DataFrame, k: int, key: str, score: str = "score", offset: int = 0) -> DataFrame:
    """Highest scores first, ties to the smaller key; rows without a match stay, at the end."""
    return scored.orderBy(F.desc(score), key).offset(offset).limit(k)


def bm25_top_k(docs: DataFrame, query: list[str], k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    return top_k(bm25_scores(docs, query, key, text), k, key)


def fts_search(docs: DataFrame, query: list[str], k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All terms must occur (implicit AND); BM25 with k1 = 1.2."""
    return top_k(bm25_scores(docs, query, key, text, k1=1.2, every=True), k, key)


def substring_search(docs: DataFrame, needle: str, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.where(F.contains(F.lower(text), F.lit(needle.lower()))).orderBy(key).limit(k)


# ---------------------------------------------------------------- vectors


def vector_scores(vectors: DataFrame, query: list[float], metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector).isNotNull()).select(key, vx.similarity(metric, F.col(vector), q).alias("score"))


def vector_scores_by_id(vectors: DataFrame, query_id: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The query is the one row of that id: one vector is broadcast."""
    q = vectors.where(F.col(key) == query_id).limit(1).select(F.col(vector).alias("_q"))
    return vectors.crossJoin(F.broadcast(q)).select(key, vx.similarity(metric, F.col(vector), F.col("_q")).alias("score"))


def find_similar(vectors: DataFrame, query_id: int, exclude: list[int], k: int = 10, metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    return top_k(vector_scores_by_id(vectors, query_id, metric, key).where(~F.col(key).isin(exclude)), k, key)


def expanded_search(vectors: DataFrame, query: list[float], expansions: list[list[float]], k: int = 10, weight: float = 0.3, least: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cosine with the query plus ``weight`` times the mean cosine with its expansions, best k; ``least`` holds for the sum."""
    lit = lambda q: F.array(*[F.lit(float(x)) for x in q])
    v = F.col(vector)
    score = vx.cosine(v, lit(query))
    if expansions:
        score = score + weight * sum((vx.cosine(v, lit(q)) for q in expansions), F.lit(0.0)) / len(expansions)
    rows = vectors.where(v.isNotNull()).select(key, score.alias("score"))
    return top_k(rows if least is None else rows.where(F.col("score") >= least), k, key)


MOST_QUERIES = 10_000


def max_sim(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Late interaction: (q_id, q) by (doc_id, d) vectors; sum over query vectors of the best cosine in each document. The
    vectors of one query text are broadcast; more than MOST_QUERIES of them are refused."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"one query has at most {MOST_QUERIES} vectors")
    pairs = docs.crossJoin(F.broadcast(queries)).select("doc_id", "q_id", vx.cosine(F.col("q"), F.col("d")).alias("s"))
    return pairs.groupBy("doc_id", "q_id").agg(F.max("s").alias("s")).groupBy("doc_id").agg(F.sum("s").alias("score"))


# ---------------------------------------------------------------- normalisation and fusion


def normalized(ranked: DataFrame, method: str = "minmax", key: str = "doc_id", score: str = "score", by: tuple[str, ...] = ()) -> Column:
    """A Column over a result set (bounded by its k), or over each query's with ``by``: minmax, zscore (through a sigmoid) or
    percentile. Equal scores: 0.5."""
    every, s = Window.partitionBy(*by), F.col(score)
    if method == "minmax":
        low, high = F.min(s).over(every), F.max(s).over(every)
        return F.when(high > low, (s - low) / (high - low)).otherwise(0.5)
    if method == "zscore":
        mean, sd = F.avg(s).over(every), F.stddev_pop(s).over(every)
        return F.when(sd > 0, 1 / (1 + F.exp(-(s - mean) / sd))).otherwise(0.5)
    if method == "percentile":
        n = F.count("*").over(every)
        return F.when(n > 1, (F.row_number().over(every.orderBy(score, key)) - 1) / (n - 1)).otherwise(0.5)
    raise ValueError(f"unknown method {method!r}")


def with_ranks(ranked: DataFrame, key: str = "doc_id", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """rank0 from 0, of a bounded result set, or of each query's with ``by``."""
    return ranked.withColumn("rank0", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key)) - 1)


def fuse(lexical: DataFrame, semantic: DataFrame, strategy: str = "rrf", lexical_weight: float = 0.5, semantic_weight: float = 0.5, k: int = 60, method: str = "minmax", key: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, source) of two bounded (key, score) lists: rrf, linear, distribution, max or store. With ``by`` the lists
    hold those of many queries, and each query's are fused on their own."""
    how = "percentile" if strategy == "distribution" else method
    prepared = [with_ranks(x, key, by=by).withColumn("norm", normalized(x, how, key, by=by)).select(*by, F.col(key), F.col("rank0").alias(f"r{t}"), F.col("norm").alias(f"n{t}")) for t, x in (("l", lexical), ("s", semantic))]
    both = prepared[0].join(prepared[1], [*by, key], "full_outer")
    nl, ns, rl, rs = (F.col(c) for c in ("nl", "ns", "rl", "rs"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    rr = lambda r: F.coalesce(1 / (k + r + 1), F.lit(0.0))
    linear = lexical_weight * z(nl) + semantic_weight * z(ns)
    score = {
        "rrf": lexical_weight * rr(rl) + semantic_weight * rr(rs),
        "linear": linear,
        "distribution": F.when((z(nl) > 0) & (z(ns) > 0), F.pow(z(nl), F.lit(lexical_weight)) * F.pow(z(ns), F.lit(semantic_weight))).otherwise(linear),
        "max": F.greatest(z(nl), z(ns)),
        "store": lexical_weight * (rr(rl) + z(nl)) + semantic_weight * (rr(rs) + z(ns)),
    }[strategy]
    source = F.when(rl.isNotNull() & rs.isNotNull(), "hybrid").when(rl.isNotNull(), "lexical").otherwise("semantic")
    return both.select(*by, key, score.alias("score"), source.alias("source"))


def fuse_rankings(rankings: list[DataFrame], weights: list[float] | None = None, k: int = 60, key: str = "doc_id") -> DataFrame:
    """Reciprocal ranks of any number of (key, score) lists; weights sum to 1."""
    weights = weights or [1.0] * len(rankings)
    total = sum(weights)
    parts = [with_ranks(r, key).select(key, (F.lit(w / total) / (k + F.col("rank0") + 1)).alias("part")) for r, w in zip(rankings, weights)]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("part").alias("score"), F.count("*").alias("n_lists"))


def hybrid_search(docs: DataFrame, vectors: DataFrame, terms: list[str], query_id: int, k: int = 10, fetch: int = 30, lexical_weight: float = 0.4, semantic_weight: float = 0.6, strategy: str = "store") -> DataFrame:
    """Lexical and vector candidates (``fetch`` of each), fused, best k."""
    lexical = bm25_top_k(docs, terms, fetch)
    semantic = top_k(vector_scores_by_id(vectors, query_id), fetch, "vec_id").withColumnRenamed("vec_id", "doc_id")
    return top_k(fuse(lexical, semantic, strategy, lexical_weight, semantic_weight), k, "doc_id")


def mmr(candidates: DataFrame, k: int = 10, lam: float = 0.7, query: str = "query_id", key: str = "doc_id", score: str = "score", vector: str = "embedding") -> DataFrame:
    """Per query, greedy pick of lam * relevance - (1 - lam) * best cosine to the picked (at least 0), ties to the smaller
    key. A group is a query's bounded candidate list."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        s = pdf[score].to_numpy(float)
        rel = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.full(len(s), 0.5)
        v = np.array(pdf[vector].tolist(), float)
        n = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        near, left, out = np.zeros(len(s)), np.ones(len(s), bool), []
        for rank in range(min(k, len(s))):
            value = np.where(left, lam * rel - (1 - lam) * near, -np.inf)
            i = int(np.argmax(value))
            out.append((pdf[query][0], rank + 1, pdf[key][i], float(value[i])))
            left[i] = False
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame(out, columns=[query, "rank", key, "mmr"])

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(query).applyInPandas(pick, f"{query} {kinds[query]}, rank int, {key} {kinds[key]}, mmr double")


# ---------------------------------------------------------------- metrics


def _gain(n: Column) -> Column:
    """Sum of 1 / log2(i + 1) over ranks 1 to n, n bounded by k."""
    n = F.coalesce(n, F.lit(0)).cast("int")
    return F.when(n < 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0)))


def metrics(hits: DataFrame, wanted: DataFrame, k: int = 10, query: str = "query_id") -> DataFrame:
    """(query, ndcg, mrr, precision, recall, average_precision) of (query, rank from 1, rel grade, 0 for none) against
    (query, grade, n): how many items of each grade there are. Gains are 2^grade - 1; the ideal list is as long as the given
    one. Queries without a relevant item have no row."""
    rel = F.col("rel") > 0
    hits = hits.withColumn("found", F.sum(rel.cast("int")).over(Window.partitionBy(query).orderBy("rank")))
    per = hits.groupBy(query).agg(
        F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min(F.when(rel, F.col("rank"))).alias("first"),
        F.count_if(rel & (F.col("rank") <= k)).alias("at_k"),
        F.sum(F.when(rel, F.col("found") / F.col("rank"))).alias("ap"),
        F.count("*").alias("listed"),
    )
    down = Window.partitionBy(query).orderBy(F.desc("grade"))  # a row a query and grade
    grades = wanted.where("grade > 0 and n > 0").withColumn("upto", F.sum("n").over(down)).join(per.select(query, "listed"), query)
    cap = F.least(F.col("listed"), F.lit(k))
    ideal = (F.pow(F.lit(2.0), F.col("grade")) - 1) * (_gain(F.least("upto", cap)) - _gain(F.least(F.col("upto") - F.col("n"), cap)))
    ideals = grades.groupBy(query).agg(F.sum(ideal).alias("ideal"), F.sum("n").alias("n_rel"))
    return per.join(ideals, query).select(
        query,
        (F.col("dcg") / F.col("ideal")).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.col("at_k") / k).alias("precision"),
        (F.col("at_k") / F.col("n_rel")).alias("recall"),
        (F.coalesce("ap", F.lit(0.0)) / F.col("n_rel")).alias("average_precision"),
    )


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """``metrics`` of (query, key, rank from 1) against (query, key) pairs, or (query, key, grade) where grades differ."""
    grade = F.col("grade") if "grade" in relevant.columns else F.lit(1)
    pairs = relevant.groupBy(query, key).agg(F.max(grade).alias("rel"))
    hits = ranked.join(pairs, [query, key], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return metrics(hits, pairs.groupBy(query, F.col("rel").alias("grade")).agg(F.count("*").alias("n")), k, query)


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-a * score - b))


def fit_platt(scores: np.ndarray, labels: np.ndarray, rate: float = 0.1, steps: int = 1000) -> tuple[float, float]:
    """Plain gradient descent on a bounded sample."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(a * scores + b))) - labels
        a, b = a - rate * float((e * scores).mean()), b - rate * float(e.mean())
    return a, b


def fit_isotonic(scored: DataFrame, score: str = "score", label: str = "label") -> tuple[list[float], list[float]]:
    """Spark ML's pool-adjacent-violators: boundaries and values, monotone."""
    from pyspark.ml.regression import IsotonicRegression

    rows = scored.select(F.col(score).cast("double").alias("features"), F.col(label).cast("double").alias("label"))
    model = IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)
    return [float(x) for x in model.boundaries], [float(x) for x in model.predictions]


def isotonic_apply(score: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear between boundaries, constant beyond."""
    out = F.when(score <= xs[0], F.lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(score <= x1, F.lit(y0) + (score - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0))
    return out.otherwise(F.lit(ys[-1]))
