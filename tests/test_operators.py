"""Order-dependent and edge-case behaviour, by hand-computed values."""

import datetime
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.functions import text as tx
from tarnfold.functions import vector as vx
from tarnfold.operators import consolidation as co
from tarnfold.operators import conversation as cv
from tarnfold.operators import filters as fl
from tarnfold.operators import retrieval as rt
from tarnfold.operators import temporal as tm
from tarnfold.operators import versioning as vs
from tarnfold.sources import io


def at(h, m=0, d=1):
    return datetime.datetime(2024, 1, d, h, m)


def test_episodes_split_by_gap_and_by_length(spark):
    stamps = [at(0), at(0, 20), at(0, 50), at(1, 21), at(9)] + [at(10 + k // 3, 20 * (k % 3)) for k in range(20)]
    df = spark.createDataFrame([("u", t, i) for i, t in enumerate(stamps)], "u string, ts timestamp, i int")
    got = [(r["first_at"], r["last_at"], r["items"]) for r in sorted(tm.episodes(df, "u", "ts", "i").collect(), key=lambda r: r["episode"])]
    assert got[0] == (at(0), at(0, 50), 3)  # 31 minutes later a new one, of one item: dropped
    assert got[1] == (at(10), at(14), 13) and got[2] == (at(14, 20), at(16, 20), 7)


def test_rate_limiter(spark):
    df = spark.createDataFrame([("a", at(0, m), m) for m in (0, 1, 2, 59)] + [("a", at(1, 0), 100), ("b", at(0), 0)], "c string, ts timestamp, i int")
    got = {(r["c"], r["i"]): r["allowed"] for r in tm.rate_limited(df, "c", "ts", "i", 2, 3600).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 59): False, ("a", 100): True, ("b", 0): True}


def test_sessions_join_at_exactly_the_gap(spark):
    df = spark.createDataFrame([("u", at(0), 0), ("u", at(1), 1), ("u", at(2) + datetime.timedelta(microseconds=1), 2)], "u string, ts timestamp, i int")
    assert [r["session"] for r in tm.sessions(df, ["u"], "ts", "i", 3600).orderBy("i").collect()] == [1, 1, 2]


def test_truncate(spark):
    rows = [(1, 1, "system", "a b c"), (1, 2, "user", "a b c d e"), (1, 3, "user", "a"), (1, 4, "user", "a b"), (1, 5, "assistant", "a b")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    kept = sorted(r["turn"] for r in cv.truncate(df, 8).collect())
    assert kept == [1, 3, 4, 5]  # 3 + 4 preserved; turn 2 would not fit, turn 3 does


def test_leader_groups(spark):
    base = "the quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(1, base, "x"), (2, base + "s", "x"), (3, "something else entirely, nothing alike", "x"), (4, "short", "x"), (5, base, "y")], "doc_id int, text string, b string")
    assert {r["doc_id"]: r["leader"] for r in co.leader_groups(df, ["b"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.9611), ("DWAYNE", "DUANE", 0.84), ("", "x", 0.0), ("same", "same", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert co.jaro_winkler(a, b) == pytest.approx(want, abs=1e-4)


def test_mmr_prefers_the_different(spark):
    df = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.9, [1.0, 0.01]), (0, 3, 0.5, [0.0, 1.0])], "query_id int, doc_id int, score double, embedding array<double>")
    assert [r["doc_id"] for r in rt.mmr(df, 2, 0.5).orderBy("rank").collect()] == [1, 3]


def test_vectors(spark):
    row = spark.range(1).select(
        vx.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("zero"), vx.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("lengths"),
        vx.similarity("euclidean", F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("far"), vx.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("unit"),
    ).first()
    assert (row["zero"], row["lengths"], row["unit"]) == (0.0, 0.0, [0.6, 0.8]) and row["far"] == pytest.approx(1 / 6)


def test_normalised_lists(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 4.0)], "doc_id int, score double")
    got = {m: [r["n"] for r in df.withColumn("n", rt.normalized(df, m)).orderBy("doc_id").collect()] for m in ("minmax", "percentile")}
    assert got == {"minmax": [0.0, 0.0, 1.0], "percentile": [0.0, 0.5, 1.0]}
    one = df.limit(1)
    assert [one.withColumn("n", rt.normalized(one, m)).first()["n"] for m in ("minmax", "zscore", "percentile")] == [0.5, 0.5, 0.5]


def test_platt_and_isotonic(spark):
    a, b = rt.fit_platt(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1]))
    assert a > 0 and 1 / (1 + np.exp(-(3 * a + b))) > 0.5
    xs, ys = rt.fit_isotonic(spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 0.0), (4.0, 1.0)], "score double, label double"))
    assert ys == sorted(ys) and xs[0] == 1.0


def test_conditions_on_missing_fields(spark):
    df = spark.createDataFrame([(1, None, None), (2, "Abc", ["t"])], "id int, name string, tags array<string>")
    ids = lambda c: [r["id"] for r in df.where(c).collect()]
    assert ids(fl.condition(F.col("name"), "ne", "x")) == [2] and ids(fl.condition(F.col("name"), "not_in", ["x"])) == [2]
    assert ids(fl.condition(F.col("name"), "contains", "B", case_sensitive=False)) == [2] and ids(fl.condition(fl.nested(df, "a.b"), "is_null")) == [1, 2]
    assert ids(fl.condition(F.col("tags"), "in", ["t", "u"], is_array=True)) == [2]


def test_clocks(spark):
    df = spark.createDataFrame([({"a": 1}, {"a": 1}), ({"a": 1}, {"a": 1, "b": 1}), ({"a": 2}, {"b": 1}), ({"a": 1}, {})], "x map<string,bigint>, y map<string,bigint>")
    assert [r[0] for r in df.select(vs.clock_order(F.col("x"), F.col("y"))).collect()] == ["equal", "before", "concurrent", "after"]


def test_jsonl_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "content": "ok"}\nnot json\n{"id": "2"}\n')
    good, bad = io.read_jsonl(spark, str(tmp_path / "x.jsonl"))
    good, bad = good.cache(), bad.cache()
    assert [r["id"] for r in good.collect()] == ["1"] and bad.count() == 2


def test_import_error_policy(spark):
    a = spark.createDataFrame([("1", "x")], "id string, origin string")
    with pytest.raises(ValueError):
        io.import_policy(a, a, "error")


def test_text(spark):
    row = spark.createDataFrame([(" Été  1 b_c! ", "One. Two?  Three")], "a string, b string").select(tx.tokens(F.col("a")).alias("t"), tx.sentences(F.col("b")).alias("s"), tx.normalized(F.col("a")).alias("n")).first()
    assert row["t"] == ["été", "1", "b_c"] and row["s"] == ["One", "Two", "Three"] and row["n"] == "été 1 b_c!"


def _texts(n):
    rng, words = random.Random(7), "alpha beta gamma delta kappa lambda sigma omega river stone cloud tree".split()
    rows = []
    for i in range(n):
        t = rows[rng.randrange(i)][1] if i and rng.random() < 0.7 else " ".join(rng.choice(words) for _ in range(rng.choice((2, 5, 8, 45))))
        for _ in range(rng.choice((0, 1, 1, 3))):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(("", "x", " Q", "é")) + t[at + rng.choice((0, 1, 2)) :]
        rows.append((i, rng.choice((t, t.upper(), f" {t} ")), i % 3))
    return rows


def test_greedy_leaders_over_the_whole_table(spark):
    """As leader clustering with one block, also across sources and sizes."""
    df = spark.createDataFrame([*_texts(120), (500, None, 0), (501, "short", 0), (502, "short", 1)], "doc_id long, text string, source int")
    want = {r["doc_id"]: r["leader"] for r in co.leader_groups(df.selectExpr("*", "1 AS one"), ["one"]).collect()}
    got = co.greedy_leaders(df).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["leader"] for r in got} == want and len(set(want.values())) < 90


def test_ratio_pairs_against_all_pairs(spark):
    rows = [(i, t) for i, t, _ in _texts(90)]
    got = {(r["a"], r["b"]): r["ratio"] for r in co.ratio_pairs(co.normalised(spark.createDataFrame(rows, "id long, text string"), "id"), 0.8, block=20).collect()}
    low = {i: t.lower().strip() for i, t in rows}
    every = {(a, b): difflib.SequenceMatcher(None, low[a], low[b]).ratio() for a in low for b in low if a < b and low[a] and low[b]}
    assert got == {k: r for k, r in every.items() if r >= 0.8} and len(got) > 50


def test_fuzzy_pairs_of_equal_and_of_unlike_word_sets(spark):
    """Equal word sets (a word twice; a line repeated) and one changed word of three are compared."""
    rows = [(1, "one two three four five six"), (2, "one two three four five six six"), (3, "configuration parameter alpha"), (4, "configuration parameter alphas"), (5, "nothing like it")]
    got = {(r["a"], r["b"]): r["ratio"] for r in co.fuzzy_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, 2), (3, 4)} and got[1, 2] == difflib.SequenceMatcher(None, rows[0][1], rows[1][1]).ratio()
