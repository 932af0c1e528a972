"""Batch vector search, fusion of many queries' lists, and graded metrics against plain loops."""

import math
import re
import sqlite3

import numpy as np
import pytest

from tarnfold.operators import dense, providers
from tarnfold.operators import retrieval as rt
from tarnfold.plans import fulltext as plans

SF = "/root/testdata/sf0.001"


def made():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 6)).round(1)
    x[50:120] = x[0]  # equal vectors: ties by key
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(400, None), (401, [math.nan] * 6), (402, [None] * 6), (403, [0.0] * 6), (404, [1.0] * 3), (405, [2.0, 1.0, 0.0]), (406, []), (None, [1.0] * 6)]


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


@pytest.mark.parametrize("few,apart", [(4096, False), (4096, True), (3, True)])
def test_batch_top_k(spark, monkeypatch, few, apart):
    for name, value in (("QUERY_ROWS", few), ("QUERY_BLOCK", 4), ("ROW_BLOCK", 90), ("STEP", 64)):
        monkeypatch.setattr(dense, name, value)
    rows = made()
    fit = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    frame = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double").repartition(3)
    asked = [(i, v) for i, v in fit if i % 25 == 0 or i > 400]
    got = dense.batch_top_k(frame, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 8, apart=apart).collect()
    for q, own in asked:
        scored = sorted((-round(cosine(own, v), 9), i) for i, v in fit if len(v) == len(own) and not (apart and i == q))[:8]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(r, i) for r, i, _ in mine] == [(r + 1, i) for r, (_, i) in enumerate(scored)]
        assert [s for *_, s in mine] == pytest.approx([-s for s, _ in scored])


def test_graded_metrics(spark):
    grades = {(1, 10): 2, (1, 11): 1, (1, 12): 1, (2, 10): 3, (3, 10): 1}
    ranked = [(1, 11, 1), (1, 99, 2), (1, 10, 3), (1, 98, 4), (2, 97, 1), (2, 96, 2), (4, 10, 1)]
    got = {r["query_id"]: r for r in rt.ranking_metrics(spark.createDataFrame(ranked, "query_id int, doc_id int, rank int"), spark.createDataFrame([(*k, g) for k, g in grades.items()], "query_id int, doc_id int, grade int"), 3).collect()}
    dcg = 1 / math.log2(2) + 3 / math.log2(4)
    ideal = 3 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert set(got) == {1, 2}
    assert got[1]["ndcg"] == pytest.approx(dcg / ideal) and got[1]["mrr"] == 1 and got[1]["precision"] == pytest.approx(2 / 3) and got[1]["recall"] == pytest.approx(2 / 3)
    assert got[1]["average_precision"] == pytest.approx((1 + 2 / 3) / 3) and got[2]["ndcg"] == 0 == got[2]["mrr"] == got[2]["recall"]


def test_stemmed_query_equals_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text, source, tokenize = 'porter unicode61')")
    con.executemany("insert into f(rowid, text, source) values (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    want = con.execute("select rowid, -bm25(f) from f where f match '(reading OR tions) NOT things'").fetchall()
    got = {r["doc_id"]: r["score"] for r in plans.fts_stemmed(spark, SF).collect()}
    assert set(got) == {i for i, _ in want} and all(got[i] == pytest.approx(s, abs=1e-6) for i, s in want)


def test_benchmark_by_methods(spark):
    """Truth and the vector row by plain loops; BM25's row is the query with SQL."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: f" {' '.join(re.findall(r'[^\W]+', (t or '').lower()))} "
    truth = {q: {i for i, d in docs if words(t) in words(d)} for q, t in items}
    truth = {q: s for q, s in truth.items() if s}
    v, a = providers.hash_embedding([t for _, t in docs]), providers.hash_embedding([t for _, t in items])
    firsts = []
    for (q, _), s in zip(items, a @ v.T):
        order = [docs[j][0] for j in sorted(range(len(docs)), key=lambda j: (-round(s[j], 9), docs[j][0]))][:10]
        if q in truth:
            firsts.append(next((r + 1 for r, i in enumerate(order) if i in truth[q]), None))
    got = {r["method"]: r for r in plans.retrieval_benchmark_methods(spark, SF).collect()}
    assert set(got) == {"bm25", "vector", "hybrid"} and all(r["queries"] == len(truth) for r in got.values())
    assert got["vector"]["mrr"] == pytest.approx(sum(1 / f for f in firsts if f) / len(firsts), abs=1e-6)
    for k in (1, 3, 5, 10):
        assert got["vector"][f"recall_{k}"] == pytest.approx(sum(bool(f and f <= k) for f in firsts) / len(firsts), abs=1e-6)
    assert got["bm25"].asDict() == {**plans.retrieval_benchmark(spark, SF).first().asDict()}
