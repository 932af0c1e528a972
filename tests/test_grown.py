"""Work that has to keep in step with the table."""

from pyspark.sql import functions as F

from tarnfold.functions import rules as rl
from tarnfold.operators import extraction as ex
from tarnfold.operators import facts as fc
from tarnfold.operators import querying as qr
from tarnfold.operators import temporal as tm
from tarnfold.plans import catalog


def test_facts_that_stand_side_by_side_are_no_part(spark, monkeypatch):
    seen = {}
    parts = fc.parts
    monkeypatch.setattr(fc, "parts", lambda *a, **k: seen.setdefault("got", parts(*a, **k)))
    rows = [(i, "d", "opening", f"a{i} b{i} c{i}", 0.5) for i in range(40)]
    batch = spark.createDataFrame(rows, "id long, domain string, key string, value string, confidence double").withColumn("ts", F.timestamp_seconds("id"))
    held, _ = fc.incremental_merge(spark.createDataFrame([], fc.FACT), batch, strategy="fuzzy", threshold=0.8, resolve="keep_both")
    assert held.count() == 40 and seen["got"].groupBy("part").count().agg(F.max("count")).first()[0] == 1


def test_words_of_a_text_are_found_once(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("",), (None,)], "t string").select(qr.chunked(F.col("t"), 3, 1).alias("c"))
    assert [r["c"] for r in df.collect()] == [["a b c", "c d e", "e f g"], [], None]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1


def test_short_runs_share_a_group(spark):
    rows = [(c, 90_000 * i + j, 1000 * c + 10 * i + j) for c in range(30) for i in range(5) for j in range(7)]
    df = spark.createDataFrame(rows, "client long, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = tm.rate_limited(df, "client", "ts", "id", 5, 86400)
    assert {r["id"]: r["allowed"] for r in got.collect()} == {i: s % 90_000 < 5 for _, s, i in rows}
    assert "session" not in got._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInPandas")[1].split("]")[0]


def test_a_relation_needs_its_verb(spark):
    assert all(rl.between(p) != p and "[A-Z]" not in rl.between(p) for p, _ in rl.RELATIONS)
    rows = [(1, "John Smith works at Acme Corp. Ann lives in Oslo"), (2, "nothing " * 50), (3, None), (4, "ANN  WORKED\nFOR acme")]
    got = ex.extract_relations(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert {(r["id"], r["predicate"]) for r in got} == {(1, "works_at"), (1, "lives_in"), (4, "works_at")}


def test_a_store_has_a_file_for_so_many_rows(spark, tmp_path, monkeypatch):
    from tarnfold.plans import stores
    from tarnfold.sources import sqlite

    made = []
    write = sqlite.write_sqlite
    monkeypatch.setattr(sqlite, "ROWS_A_FILE", 30)
    monkeypatch.setattr(stores.sqlite, "write_sqlite", lambda df, *a: (made.append(df.rdd.getNumPartitions()), write(df, *a))[1])
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    catalog.queries()["sqlite_roundtrip"](spark, "/root/testdata/sf0.001").count()
    assert made == [-(-n // 30)] and n > 120


def test_long_texts_are_held_apart_by_what_difflib_starts_at(spark, monkeypatch):
    """Texts beyond AUTOJUNK in one language: all pairs, and subsequences are looked at for the alike ones alone."""
    import difflib
    import random

    from tarnfold.operators import consolidation as co

    rng, rows = random.Random(5), []
    parts = ["tion", "er", "th", "an", "in", "wh", "ou", "re", "of", "and", "ly", "es", "the", "st"]
    for i in range(24):
        t = " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice((30, 90, 120)))) + rng.choice((".", "!", " 7, 8"))
        if i % 3 == 2:
            t = rows[-1][1]
            for _ in range(rng.choice((1, 9, 25))):
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice(("", "x", "é 9")) + t[at + rng.choice((0, 1, 6)) :]
        rows.append((i, t))
    want = {(a, b): difflib.SequenceMatcher(None, s, t).ratio() for a, s in rows for b, t in rows if a < b}
    got = {(r["a"], r["b"]): r["ratio"] for r in co.ratio_pairs(spark.createDataFrame(rows, "id long, t string"), 0.8, block=7).collect()}
    assert got == {k: r for k, r in want.items() if r >= 0.8} and len(got) > 3
    text = rows[0][1]
    assert sum(co._unpopular(t) < len(t) // 5 for _, t in rows) > 20 and co._unpopular(text[:199]) > 10**9


def test_single_words_are_searched_without_positions(spark, tmp_path):
    from tarnfold.operators import fulltext as ft

    rows = [(1, "le the \u00c9t\u00e9 cafe\u0301", "le x"), (2, "the end", "le"), (3, None, "die die"), (4, "other", None)]
    folded = ft.Analyzer(porter=False)
    index = ft.build(spark.createDataFrame(rows, "doc_id long, text string, source string"), f"{tmp_path}/i", ("text", "source"), analyzer=folded)
    assert {(r["term"], r["df"], r["cf"]) for r in index.terms(spark).collect()} >= {("le", 2, 3), ("die", 1, 2), ("ete", 1, 1), ("cafe", 1, 1)}
    tops = {(r["term"]): r["top"] for r in index.blocks(spark).where("term = 'le' and top > 1").collect()}
    assert abs(tops["le"] - 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 6 / index.mean))) < 1e-9  # of both columns together
    single = ft.occurrences(spark, index, ft.phrases(ft.parse("source : le OR the OR di*", folded, ("text", "source"))))
    assert "positions" not in single._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert {tuple(r) for r in single.select("key", "f0", "f1", "f2").collect()} == {(1, 1, 1, 0), (2, 1, 1, 0), (3, 0, 0, 2)}
    for word in ("\u00c9t\u00e9", "reading", "stra\u00dfe"):
        assert [ft.PORTER.term(word.lower())] == ft.PORTER.terms(word)


def test_blocks_of_vectors_grow_with_the_table(spark, monkeypatch):
    import numpy as np

    from tarnfold.operators import similarity as sm

    rng, made = np.random.default_rng(3), []
    keep = sm.cut
    monkeypatch.setattr(sm, "cut", lambda df: made.append(keep(df)) or made[-1])
    monkeypatch.setattr(sm, "BLOCKS", 2)
    monkeypatch.setattr(sm, "STEP", 7)
    x = rng.standard_normal((90, 3))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["a"], r["b"]) for r in sm.similar_vectors(df, 0.9, block=5).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    assert got == {(a, b) for a in range(90) for b in range(a + 1, 90) if u[a] @ u[b] >= 0.9} and got
    assert made[1].count() == made[1].select("dim", "band").distinct().count()  # no band beyond a block of 45
    assert dict(made[0].dtypes)["v"] == "array<float>"


def test_ends_are_told_apart_in_parts(spark, monkeypatch):
    from tarnfold.operators import graph as gr

    monkeypatch.setattr(gr, "ROWS", 10)
    edges = spark.createDataFrame([(f"a{i % 7}", f"b{i % 5}") for i in range(60)] + [("a1", "a1")], "src string, dst string")
    got = gr.degrees(edges)
    assert {r["id"]: r["degree"] for r in got.collect()} == {**{f"a{i}": 5 + (i == 1) for i in range(7)}, **{f"b{i}": 7 for i in range(5)}}
    assert "RepartitionByExpression [src#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "], 13" in plan


def test_exact_facts_need_no_search_for_components(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a search")

    monkeypatch.setattr(fc, "connected_components", none)
    rows = [(1, "d", "K", "x"), (2, "d", "k", "X"), (3, "d", "k", "y"), (4, "e", "k", "x"), (5, None, None, None), (6, None, "", "")]
    df = spark.createDataFrame(rows, "place long, domain string, key string, value string")
    part = lambda conflicts: {r["place"]: r["part"] for r in fc.parts(df, "exact", 0.85, conflicts).collect()}
    assert part(False) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5} and part(True) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_postings_meet_blocks_of_queries(spark, tmp_path, monkeypatch):
    """Blocks, parts and tiles of any size give what plain sums give, over two columns too, and no row is made a query and document."""
    import math
    from collections import Counter

    from tarnfold.operators import fulltext as ft

    for name, value in (("QUERIES", 3), ("DOCUMENTS", 9), ("TILE", 4)):
        monkeypatch.setattr(ft, name, value)
    docs = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 13)), f"w{i % 3}") for i in range(60)] + [(i, "w1 w2 w3", "w9") for i in range(60, 75)] + [(90, None, None)]
    words = {i: Counter(f"{t or ''} {s or ''}".split()) for i, t, s in docs}
    index = ft.build(spark.createDataFrame(docs, "doc_id long, text string, source string"), f"{tmp_path}/i", ("text", "source"), analyzer=ft.PLAIN, k1=1.5)
    asked = [(q, f"w{t}", 1 + t % 2) for q in range(8) for t in range(q, 12, 2)] + [(9, "absent", 1)]
    got = ft.batch_top_k(spark, index, spark.createDataFrame(asked, "query_id int, term string, times long"), 6)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]
    mean = sum(sum(c.values()) for c in words.values()) / len(words)
    df = Counter(w for c in words.values() for w in c)
    want = set()
    for q in range(8):
        score = {}
        for i, c in words.items():
            for _, w, times in [a for a in asked if a[0] == q and a[1] in c]:
                idf = max(0.25, math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1))
                score[i] = score.get(i, 0) + times * idf * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
        want |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted((-round(s, 9), i) for i, s in score.items())[:6])}
    assert {(r["query_id"], r["key"], r["rank"]) for r in got.collect()} == want


def test_a_word_is_hashed_once_a_block_of_texts(monkeypatch):
    import hashlib

    from tarnfold.operators import providers

    made, plain = [], hashlib.blake2b
    monkeypatch.setattr(providers.hashlib, "blake2b", lambda b, digest_size: made.append(b) or plain(b, digest_size=digest_size))
    got = providers.hash_embedding(["a b a", None, "", "B a"] * 50)
    assert sorted(made) == [b"a", b"b"] and got.shape == (200, 64) and not got[1].any() and (got[4:8] == got[:4]).all()
    assert abs(float(got[0] @ got[0]) - 1) < 1e-12


def test_a_full_part_of_postings_has_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tarnfold.operators import fulltext as ft

    rng = np.random.default_rng(1)
    terms = np.array([f"w{i}" for i in range(6000)])
    query = np.repeat(np.arange(ft.QUERIES), 40)
    asked = pa.table({"query_id": query, "term": terms[np.arange(len(query)) % len(terms)], "idf": rng.random(len(query))})
    postings = pa.table({"term": terms[rng.integers(0, len(terms), ft.POSTINGS)], "key": rng.integers(0, ft.DOCUMENTS, ft.POSTINGS), "w": rng.random(ft.POSTINGS)})
    tracemalloc.start()
    try:
        found = ft._met(10)(postings, asked)
        assert found.num_rows == 10 * ft.QUERIES and tracemalloc.get_traced_memory()[1] < 150 << 20
    finally:
        tracemalloc.stop()
