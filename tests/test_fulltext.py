"""The positional index against SQLite's FTS5 and against plain loops."""

import math
import re
import sqlite3
import uuid
from collections import Counter

import pytest

from tarnfold.functions.stemming import stem
from tarnfold.operators import fulltext as ft
from tarnfold.operators import retrieval as rt
from tarnfold.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def folder(spark):
    return f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"


MADE = [
    (1000, "The quick brown fox", "animals fable"), (1001, "A quick red fox", "animals"), (1002, "Brown lazy dog", None), (1003, None, "quick only in meta"), (1004, "", ""),
    (1005, "running runner runs: ran; Running!", "verbs"), (1006, "Éclair déjà vu, naïve façade", "accents"), (1007, "a a a a b a a", "letters"), (1008, "x " * 30_000 + "needle", "long"),
    (1009, "quick\nbrown\tquick brown quick", "again"), (1010, "under_score and hy-phen 42 4x2", "marks"),
]
QUERIES = [
    "quick", '"quick brown"', "quick AND fox", "quick fox", "fox OR dog", "quick NOT brown", '"a a a"', "runn*", '"quick bro" *', "quick + brown", "(fox OR dog) AND brown", "meta : quick", "text : quick", "{text meta} : fox",
    "eclair", "DÉJÀ", "the", "and", "erthreand OR the", '"of the"', "tion*", "t* NOT the", "fox NOT dog OR lazy", "run", "nothingatall", "quick brown OR lazy dog", '"needle"', "hy-phen" if False else '"hy-phen"', "4x2", "in AND the AND of",
]


@pytest.fixture(scope="module")
def rows(spark):
    return MADE + [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, meta string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs):
    return ft.build(docs, folder(spark), ("text", "meta"))


@pytest.fixture(scope="module")
def sqlite(rows):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text, meta, tokenize = 'porter unicode61')")
    con.executemany("insert into f(rowid, text, meta) values (?, ?, ?)", rows)
    return con


@pytest.mark.parametrize("query", QUERIES)
def test_matches_and_scores_equal_fts5(spark, index, sqlite, query):
    want = dict(sqlite.execute("select rowid, -bm25(f) from f where f match ?", (query,)).fetchall())
    got = {r["doc_id"]: r["score"] for r in ft.search(spark, index, query, None).collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-6, abs=1e-9) for i in want)


def test_nested_queries_match_as_fts5_does(spark, index, sqlite):
    for query in ("quick OR (the AND brown)", "(quick OR lazy) NOT (red OR dog)", "the AND (in OR (of NOT and))"):
        want = {i for (i,) in sqlite.execute("select rowid from f where f match ?", (query,))}
        assert {r["doc_id"] for r in ft.search(spark, index, query, None).collect()} == want


def test_order_limit_offset_and_alive(spark, docs, index):
    every = [(r["doc_id"], r["score"]) for r in ft.search(spark, index, "the OR of", None).collect()]
    order = sorted(every, key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in ft.search(spark, index, "the OR of", 5, offset=3).collect()] == order[3:8]
    kept = docs.where("doc_id % 2 = 0")
    assert {r[0] for r in ft.search(spark, index, "the OR of", None, alive=kept).collect()} == {i for i, _ in every if i % 2 == 0}
    assert ft.search(spark, index, '"" ...').collect() == [] == ft.search(spark, index, "").collect()


def test_queries_that_are_no_queries():
    for bad in ("AND", "a AND", "(a", "a)", '"open', "nosuch : a", "a NOT", "* a", "OR b"):
        with pytest.raises(ValueError):
            ft.parse(bad, columns=("text",))
    assert ft.parse('a "b c" AND d', ft.PLAIN) == ft.Node("and", (ft.Node("and", (ft.Phrase(("a",)), ft.Phrase(("b", "c")))), ft.Phrase(("d",))))


def test_reopened_index_and_pushed_filters(spark, index):
    again = ft.opened(spark, index.path)
    assert again == index
    plan = ft.search(spark, again, 'fox "quick bro"*')._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(term,bro)" in scan and re.search(r"In\(term, \[.*fox", scan) and "crossJoin" not in plan


def test_index_holds_every_word(spark, docs, rows):
    index = ft.build(docs, folder(spark), ("text",), analyzer=ft.PLAIN)
    df, cf = Counter(), Counter()
    for _, text, _ in rows:
        words = re.findall(r"\w+", (text or "").lower())
        cf.update(words)
        df.update(set(words))
    assert {r["term"]: (r["df"], r["cf"]) for r in index.terms(spark).collect()} == {t: (df[t], cf[t]) for t in df}
    assert index.n == len(rows) and math.isclose(index.mean, sum(cf.values()) / len(rows))
    empty = ft.build(docs.limit(0), folder(spark))
    assert empty.n == 0 and ft.search(spark, empty, "fox").collect() == []


def test_stemmer():
    for word, want in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "happy": "happi", "relational": "relat", "sensibiliti": "sensibl", "electriciti": "electr", "adoption": "adopt", "controll": "control", "is": "is", "y": "y"}.items():
        assert stem(word) == want


@pytest.mark.parametrize("pushed,small", [(5000, 500_000), (3, 2)])
def test_batch_equals_single_searches(spark, docs, monkeypatch, pushed, small):
    monkeypatch.setattr(ft, "PUSHED_TERMS", pushed)
    monkeypatch.setattr(ft, "BROADCAST_ROWS", small)
    index = ft.build(docs, folder(spark), analyzer=ft.PLAIN, k1=1.5)
    texts = ["the than and the", "quick brown fox", "of thin erthand in of", "nothingatall", "", None, "the of and to in", "a"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = ft.batch_top_k(spark, index, ft.asked(queries, ft.PLAIN), 7).collect()
    for i, text in enumerate(texts):
        single = rt.bm25_scores(docs, (text or "").split()).where("score > 0").orderBy("score", ascending=False).collect() if text else []
        want = sorted(((-r["score"], r["doc_id"]) for r in single))[:7]
        mine = sorted((r["rank"], r["key"], r["score"]) for r in got if r["query_id"] == i)
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in want])
        assert [m[1] for m in mine] == [j for _, j in want]


def test_workers_hold_some_words_at_a_time(monkeypatch):
    import pyarrow as pa

    from tarnfold.operators import fulltext as ft

    monkeypatch.setattr(ft, "WORDS", 10)
    words = [[f"w{i}_{j % 3}" for j in range(i % 7)] for i in range(50)] + [["long"] * 40, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(52)), pa.array(words, pa.list_(pa.string()))], names=["key", "w0"])
    out = list(ft._postings(ft.PLAIN, 1)(iter([batch])))
    assert len(out) > 10 and all(sum(b["tf"].to_pylist()) <= 10 or len(set(b["key"].to_pylist())) == 1 for b in out)
    got = {(t, k): (n, p) for b in out for t, k, n, p in zip(*(b[c].to_pylist() for c in ("term", "key", "tf", "positions")))}
    assert got == {(t, k): (w.count(t), [i for i, x in enumerate(w) if x == t]) for k, w in enumerate(words) for t in set(w)}
