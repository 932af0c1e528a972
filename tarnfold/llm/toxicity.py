"""Toxicity by a classifier chain: linear models category by category, each also fed the earlier ones' probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.llm.text import each, tidy
from tarnfold.session import cut

WORD = re.compile(r"\w+")
PREFIX = 5
MAX_ROWS = 12_000
FEATURES = 4096
CHAIN = ("low_quality", "toxic")


def features(text: str | None) -> set[str]:
    """Distinct words, and for longer words their first letters followed by ``*``. Null: none."""
    if not text:
        return set()
    words = set(WORD.findall(text.lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


@dataclass(frozen=True)
class Link:
    """One category's model: bias, weights of features, weights of the earlier categories' probabilities."""

    name: str
    bias: float
    weights: dict[str, float]
    earlier: tuple[float, ...]
    threshold: float = 0.5


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """From out-of-fold probabilities the cut of highest F1, midway in log odds between its neighbours; then halfway from
    there to 0.5, as the model of all rows is surer than those of the folds."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities stay together
    i = int(np.argmax(f1))
    low = p[i + 1] if i + 1 < len(p) else 0.0
    odds = lambda x: np.log(np.clip(x, 1e-9, 1 - 1e-9) / (1 - np.clip(x, 1e-9, 1 - 1e-9)))
    return float(sigmoid((odds(p[i]) + odds(low)) / 4))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, n: int, m: int, dense: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 300) -> np.ndarray:
    """Ridge logistic regression on a sparse 0/1 matrix (coordinates) beside dense columns; the last weight is the bias.
    Full-batch steps, each weight scaled by its own curvature bound."""
    w, out = np.zeros(m), np.zeros(dense.shape[1] + 1)
    d = np.hstack([dense, np.ones((n, 1))])
    rate = min(max(y.mean(), 1 / (2 * n)), 1 - 1 / (2 * n))
    out[-1] = np.log(rate / (1 - rate))
    size = np.bincount(rows, minlength=n).mean() + d.shape[1]
    cw, cd = np.bincount(cols, minlength=m) * 0.25 + ridge, (d * d).sum(0) * 0.25 + ridge
    vw, vd, mw, md = w * 0, out * 0, w * 0, out * 0
    for step in range(1, steps + 1):
        p = sigmoid(np.bincount(rows, w[cols], n) + d @ out)
        gw, gd = (np.bincount(cols, (p - y)[rows], m) + ridge * w) / cw, d.T @ (p - y)
        gd[:-1] += ridge * out[:-1]
        gd = gd / cd
        mw, md = 0.9 * mw + 0.1 * gw, 0.9 * md + 0.1 * gd
        vw, vd = 0.99 * vw + 0.01 * gw * gw, 0.99 * vd + 0.01 * gd * gd
        a, b = 1 - 0.9**step, 1 - 0.99**step
        scale = 0.3 / np.sqrt(size) / (1 + step / 50)
        w = w - scale * (mw / a) / (np.sqrt(vw / b) + 1e-8)
        out = out - scale * (md / a) / (np.sqrt(vd / b) + 1e-8)
    return np.concatenate([w, out])


@dataclass(frozen=True)
class Examples:
    """Labelled rows as coordinates: row numbers and feature numbers, the features' names, 0/1 labels by category, and by
    category the features that its model may use."""

    rows: np.ndarray
    cols: np.ndarray
    names: list[str]
    labels: dict[str, np.ndarray]
    own: dict[str, np.ndarray]


def fit_chain(given: Examples, chain: tuple[str, ...] = CHAIN, folds: int = 3) -> list[Link]:
    """Models in chain order. Later ones train on the earlier ones' out-of-fold probabilities, so they see them as they
    will be in use. A category of one class, or without rows, has a constant."""
    n = len(given.labels[chain[0]])
    fold = np.arange(n) % folds
    earlier, links = np.empty((n, 0)), []
    for name in chain:
        y = given.labels[name].astype(float)
        rate = y.mean() if n else 0.0
        if rate in (0.0, 1.0):
            links.append(Link(name, 40.0 if rate else -40.0, {}, (0.0,) * len(links)))
            earlier = np.hstack([earlier, np.full((n, 1), rate)])
            continue
        chosen = given.own[name]
        to = np.full(len(given.names), -1)
        to[chosen] = np.arange(len(chosen))
        keep = to[given.cols] >= 0
        r, c, m = given.rows[keep], to[given.cols[keep]], len(chosen)

        def model(on: np.ndarray) -> np.ndarray:
            at = np.cumsum(on) - 1
            use = on[r]
            return fit_logistic(at[r[use]], c[use], int(on.sum()), m, earlier[on], y[on])

        def odds(w: np.ndarray) -> np.ndarray:
            return np.bincount(r, w[:m][c], n) + earlier @ w[m:-1] + w[-1]

        out = np.zeros(n)
        for f in range(folds):
            if (fold != f).any() and (fold == f).any():
                out[fold == f] = sigmoid(odds(model(fold != f)))[fold == f]
        w = model(np.ones(n, bool))
        links.append(Link(name, float(w[-1]), {given.names[j]: float(x) for j, x in zip(chosen, w[:m]) if abs(x) > 1e-9}, tuple(float(x) for x in w[m:-1]), best_threshold(out, y)))
        earlier = np.hstack([earlier, out[:, None]])
    return links


def examples(found: DataFrame, chain: tuple[str, ...], n_features: int = FEATURES, least: int = 3) -> Examples:
    """From (_k, found array<string>, a 0/1 column a category). Features are chosen by aggregates: by category the
    ``n_features`` of the highest |z| over 3 among those of at least ``least`` rows, ties to the name first in order. The
    driver sees these names, and of each row the numbers of the chosen features that it has."""
    total = found.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in chain]).first()
    n = total["n"]
    df = F.col("df")
    counts = found.select(F.explode("found").alias("name"), *chain).groupBy("name").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in chain]).where(df >= least)
    rates = {c: total[c] / n if n else 0.0 for c in chain}
    live = [c for c in chain if 0 < rates[c] < 1]
    own_names: dict[str, list[str]] = {c: [] for c in chain}
    if live:
        z = {c: F.abs(F.col(c) - df * rates[c]) / F.sqrt(df * rates[c] * (1 - rates[c])) for c in live}
        counts = cut(counts.select("name", *[z[c].alias(c) for c in live]))
        for c in live:
            own_names[c] = [r["name"] for r in counts.where(F.col(c) > 3).orderBy(F.desc(c), "name").limit(n_features).select("name").collect()]
    names = sorted({x for own in own_names.values() for x in own})
    number = {x: i for i, x in enumerate(names)}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[number[x] for x in row if x in number] for row in each(batch.column("found"))]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(ids, pa.list_(pa.int32())), *[batch.column(c) for c in chain]], names=["_k", "ids", *chain])

    kind = dict(found.dtypes)["_k"]
    table = found.mapInArrow(coded, f"_k {kind}, ids array<int>, " + ", ".join(f"{c} int" for c in chain)).toArrow().combine_chunks()
    # one order of rows whatever the partitions: by key, then by what the row has
    table = table.append_column("_m", pc.list_value_length(table["ids"])).sort_by([("_k", "ascending"), ("_m", "ascending"), *[(c, "ascending") for c in chain]])
    ids = table["ids"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))
    rows = np.repeat(np.arange(len(table)), pc.list_value_length(ids).to_numpy(zero_copy_only=False)) if len(table) else np.empty(0, int)
    cols = ids.flatten().to_numpy(zero_copy_only=False).astype(int)
    return Examples(rows, cols, names, {c: table[c].to_numpy() for c in chain}, {c: np.array(sorted(number[x] for x in own), int) for c, own in own_names.items()})


def fit(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, n_features: int = FEATURES, least: int = 3, folds: int = 3) -> list[Link]:
    """From at most about ``max_rows`` labelled documents, those of the least hash.

    Labels have the key and one 0/1 column a category; rows with a null are no examples, nor are labels without a
    document. Null and empty texts are examples without features; very long ones are read whole; repeated rows count
    each; without any example every category has probability 0. Other columns, whatever their names, are ignored.
    """
    whole = labels.select(F.col(key).alias("_k"), *[F.col(c).cast("int").alias(c) for c in chain]).dropna()
    n = whole.count()
    if n > max_rows:
        whole = whole.where(F.pmod(F.xxhash64("_k"), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    chosen = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(whole), "_k").select("_k", "_t", *chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([sorted(features(t)) for t in each(batch.column("_t"))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), got, *[batch.column(c) for c in chain]], names=["_k", "found", *chain])

    kind = dict(chosen.dtypes)["_k"]
    found = cut(chosen.mapInArrow(work, f"_k {kind}, found array<string>, " + ", ".join(f"{c} int" for c in chain)))
    return fit_chain(examples(found, chain, n_features, least), chain, folds)


def probabilities(links: list[Link], texts: Iterable[str | None], n: int | None = None) -> np.ndarray:
    """rows x categories, in chain order; ``n`` rows, where the texts' number isn't theirs to tell."""
    keys, out = [link.weights.keys() for link in links], np.zeros((len(texts) if n is None else n, len(links)))
    for i, text in enumerate(texts):
        found = features(text)
        for k, link in enumerate(links):
            get = link.weights.__getitem__
            z = link.bias + sum([get(x) for x in sorted(keys[k] & found)])
            out[i, k] = sigmoid(z + sum(a * p for a, p in zip(link.earlier, out[i])))
    return out


def score(docs: DataFrame, links: list[Link], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(*keep, p_<category>...): whole texts, where they lie. Null and empty texts have the models' base probabilities;
    repeated rows come back each; an empty table gives no rows."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([rows.schema[k] for k in keep] + [T.StructField(f"p_{x.name}", T.DoubleType()) for x in links])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(links, each(batch.column("__text")), len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(p[:, k]) for k in range(p.shape[1])], names=schema.names)

    return rows.mapInArrow(work, schema)


def keep_clean(docs: DataFrame, links: list[Link], category: str = "toxic", threshold: float | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose probability of the category is under the threshold, by default the model's own.

    All columns come back as they were. Null and empty texts are judged by the models' base probabilities; very long
    ones are read whole; repeated rows stay or go together; a probability equal to the threshold is rejected; an empty
    table gives no rows. The models (at most n_features weights a category) travel with the tasks.
    """
    which = [x.name for x in links].index(category)
    threshold = links[which].threshold if threshold is None else threshold

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(links, each(batch.column(text)), len(batch))[:, which] < threshold))
        tidy()

    return docs.mapInArrow(work, docs.schema)


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op2_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; fitted on the labels: low quality first, then toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    links = fit(docs, label_table(spark, sf_dir))
    return score(docs, links).withColumn("rejected", F.col("p_toxic") >= links[-1].threshold)
