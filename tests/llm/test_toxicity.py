import random

import numpy as np
import pytest

from tarnfold.llm import toxicity


def made(seed, n=900):
    rng = random.Random(seed)
    vocab, bad, junk = [f"v{k}" for k in range(300)], ["vileword", "nasty", "grossest"], [f"zz{k}" for k in range(5)]
    rows = []
    for i in range(n):
        t, q = rng.random() < 0.15, rng.random() < 0.2
        w = [rng.choice(vocab) for _ in range(rng.choice([5, 40, 400]))]
        for _ in range(3 * t):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        for _ in range(4 * q):
            w.insert(rng.randrange(len(w)), rng.choice(junk))
        rows.append((i, " ".join(w), int(q), int(t)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (5000, None, "x")], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows[:600]] + [(601, None, 1), (None, 1, 1), (9999, 0, 0)], "doc_id long, low_quality int, toxic int")
    links = toxicity.fit(docs, labels)
    assert [x.name for x in links] == ["low_quality", "toxic"] and len(links[1].earlier) == 1
    got = toxicity.score(docs, links).collect()
    assert len(got) == len(rows) + 3
    p = {r["doc_id"]: r["p_toxic"] for r in got}
    held = [(p[i] >= links[1].threshold, bool(t)) for i, _, _, t in rows[600:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    clean = toxicity.keep_clean(docs, links)
    assert clean.columns == docs.columns
    kept = {r["doc_id"] for r in clean.collect()}
    assert {i for i, _, _, t in rows if not t} - kept == set() or len({i for i, _, _, t in rows if not t} - kept) < 8
    assert {5000, 5001} <= kept


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    assert [r["p_toxic"] < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [True, True]
    ones = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, low_quality int, toxic int")
    assert [r["p_toxic"] > 0.99 for r in toxicity.score(docs, toxicity.fit(docs, ones)).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0


def newton(x, y, ridge=0.1, steps=60):
    """Dense ridge logistic regression, bias last and free, solved exactly."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-9]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w - 0.7 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (p - y) + pull * w)
    return w


def plain_chain(rows, chain, folds=3, least=3):
    """Chain by the definition, over (features, labels) rows: dense matrices, chosen features, exact models."""
    names = sorted({f for found, _ in rows for f in found})
    x = np.array([[f in found for f in names] for found, _ in rows], float)
    fold, earlier, models = np.arange(len(rows)) % folds, np.empty((len(rows), 0)), []
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for k in range(len(chain)):
        y = np.array([labels[k] for _, labels in rows], float)
        df, rate = x.sum(0), y.mean()
        z = np.abs(x.T @ y - df * rate) / np.sqrt(df * rate * (1 - rate))
        own = (df >= least) & (z > 3)
        full = np.hstack([x[:, own], earlier])
        out = np.zeros(len(rows))
        for f in range(folds):
            w = newton(full[fold != f], y[fold != f])
            out[fold == f] = sig(full[fold == f] @ w[:-1] + w[-1])
        models.append(({n for n, o in zip(names, own) if o}, newton(full, y)))
        earlier = np.hstack([earlier, out[:, None]])

    def score(found):
        p = []
        for own, w in models:
            v = np.r_[[f in found for f in sorted(own)], p, 1.0]
            p.append(float(sig(v @ w)))
        return p

    return models, score


def test_against_a_plain_chain(spark):
    rows = made(5, 700)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows[:500]], "doc_id long, low_quality int, toxic int")
    links = toxicity.fit(docs, labels)
    models, score = plain_chain([(toxicity.features(t), (q, y)) for _, t, q, y in rows[:500]], toxicity.CHAIN)
    for link, (own, _) in zip(links, models):
        assert set(link.weights) <= own and len(own - set(link.weights)) <= len(own) // 10
    p, want = toxicity.probabilities(links, [t for _, t, _, _ in rows]), np.array([score(toxicity.features(t)) for _, t, _, _ in rows])
    assert np.abs(p - want).mean() < 0.05
    assert ((p > 0.5) == (want > 0.5)).mean(0).min() > 0.97


def test_examples_are_aggregates_of_what_rows_have(spark):
    found = [(1, ["a", "b"], 1), (2, ["a"], 1), (3, ["a", "c"], 1), (4, [], 0)] + [(k, ["c", "d"], 0) for k in range(5, 25)]
    got = toxicity.examples(spark.createDataFrame(found, "_k long, found array<string>, y int"), ("y",))
    # z of a: |3 - 3 * 3/24| / sqrt(3 * 3/24 * 21/24) = 4.2; b has one row; c and d are under 3
    assert got.names == ["a"] and got.rows.tolist() == [0, 1, 2] and got.cols.tolist() == [0, 0, 0] and got.labels["y"].sum() == 3
    assert toxicity.examples(spark.createDataFrame(found, "_k long, found array<string>, y int"), ("y",), least=1).names == ["a"]


def test_long_texts_ties_and_clashing_columns(spark):
    long = " ".join(["v1 v2 v3"] * 100_000) + " vileword"
    docs = spark.createDataFrame([(1, long, "x", 1), (1, long, "x", 1), (2, None, None, None)], "doc_id long, text string, found string, _k int")
    link = toxicity.Link("toxic", -1.0, {"vileword": 1.0}, ())
    # the sum is the threshold's own odds: rejected
    assert [r["doc_id"] for r in toxicity.keep_clean(docs, [link], threshold=0.5).collect()] == [2]
    assert toxicity.keep_clean(docs, [link], threshold=0.51).columns == docs.columns
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, chain=("toxic",))) == 1
    assert toxicity.fit(docs, labels, chain=("toxic",), max_rows=0)[0].weights == {}


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    first = rng.random(800) < 0.5
    second = first ^ (rng.random(800) < 0.02)
    at = np.flatnonzero(first)
    given = toxicity.Examples(at, np.zeros(len(at), int), ["sign"], {"a": first.astype(int), "b": second.astype(int)}, {"a": np.array([0]), "b": np.empty(0, int)})
    links = toxicity.fit_chain(given, ("a", "b"))
    assert links[1].earlier[0] > 0.5


@pytest.mark.parametrize("text,want", [(None, set()), ("", set()), ("Ab, ab! abcdefg", {"ab", "abcdefg", "abcde*"})])
def test_features(text, want):
    assert toxicity.features(text) == want
