"""Queries without SQL of plans.runs, held against plain Python over the registered tables; and small cases."""

import difflib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import conflicts as cf
from tarnfold.operators import lifecycle as lc
from tarnfold.operators import similarity as sm
from tarnfold.operators import summaries as su
from tarnfold.plans import catalog
from tests.test_queries import SF

Q = catalog.queries()


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()


def test_hybrid_similarity(spark):
    said = {(r["conv_id"], r["turn"]): r["text"] for r in rows(spark, "conversations")}
    v = {r["vec_id"]: r["embedding"] for r in rows(spark, "embeddings")}
    got = {(r["conv_id"], r["turn"]): r["similarity"] for r in Q["pair_similarity_hybrid"](spark, SF).collect()}
    want = {k: t for k, t in said.items() if (k[0], k[1] + 1) in said}
    assert set(got) == set(want)
    for (c, t), a in want.items():
        f = ratio(a, said[c, t + 1])
        s = cosine(v[c], v[c + 1]) if c in v and c + 1 in v else f
        assert got[c, t] == pytest.approx(0.3 * f + 0.7 * s, abs=1e-5)


def greedy(ids, like):
    leaders, out = [], {}
    for i in ids:
        out[i] = next((k for k in leaders if like(k, i)), i)
        if out[i] == i:
            leaders.append(i)
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_semantic_groups(spark, threshold):
    v = {r["vec_id"]: r["embedding"] for r in rows(spark, "embeddings")}
    rng = np.random.default_rng(1)
    made = {**v, **{1000 + k: (np.array(v[k % 9], float) + rng.standard_normal(len(v[0])) * 0.02).tolist() for k in range(120)}}
    df = spark.createDataFrame([(k, [float(x) for x in e]) for k, e in made.items()] + [(5000, None), (5001, [0.0] * len(v[0]))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["leader"] for r in sm.semantic_groups(df, threshold).collect()}
    want = greedy(sorted(made), lambda a, b: cosine(made[a], made[b]) >= threshold)
    assert got == {**want, 5000: 5000, 5001: 5001}
    if threshold == 0.9:
        assert {r["vec_id"]: r["leader"] for r in Q["semantic_groups"](spark, SF).collect()} == greedy(sorted(v), lambda a, b: cosine(v[a], v[b]) >= 0.9)


def plain_fact_groups(facts, like):
    leaders, of = [], {}
    for i, key, value, confidence, vector in facts:
        found = next((x for x in leaders if like((key, value, vector), x["form"])), None)
        if found is None:
            leaders.append({"form": (key, value, vector), "c": confidence, "kept": i, "m": [i]})
        else:
            found["m"].append(i)
            if confidence > found["c"]:
                found.update(form=(key, value, vector), c=confidence, kept=i)
    for x in leaders:
        of.update({i: x["kept"] for i in x["m"]})
    return of


def overlap(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


def test_fact_groups(spark):
    from tarnfold.plans.runs import _facts

    facts = sorted(_facts(spark, SF).collect(), key=lambda r: r["id"])
    want = {}
    for domain in {r["domain"] for r in facts}:
        seen, one = {}, []
        for r in (r for r in facts if r["domain"] == domain):
            k = (r["key"], r["value"], r["confidence"])
            if k not in seen:
                seen[k] = r["id"]
                one.append((r["id"], r["key"], r["value"], r["confidence"], None))
        of = plain_fact_groups(one, lambda a, b: 0.3 * overlap(a[0], b[0]) + 0.7 * overlap(a[1], b[1]) >= 0.85)
        want |= {r["id"]: of[seen[r["key"], r["value"], r["confidence"]]] for r in facts if r["domain"] == domain}
    assert {r["id"]: r["kept"] for r in Q["fact_groups_fuzzy"](spark, SF).collect()} == want


def test_fact_groups_by_vector(spark):
    data = [(1, "d", "k", "a", 0.2, [1.0, 0.0]), (2, "d", "k", "b", 0.9, [0.95, 0.3]), (3, "d", "k", "c", 0.1, [0.8, 0.6]), (4, "d", "k", "d", 0.1, [0.0, 1.0]), (5, "e", "k", "a", 0.5, [1.0, 0.0])]
    df = spark.createDataFrame(data, "id int, domain string, key string, value string, confidence double, vector array<double>")
    # 2 takes the place of 1, and 3 is near 2 only
    assert {r["id"]: r["kept"] for r in sm.fact_groups(df, "id", "semantic", 0.9).collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}


def pieces(text):
    return [s for s in (re.sub(r"^\s+|\s+$", "", x) for x in re.split(r"[.!?]+", text)) if s]


def weight(s, i, n):
    w = len(re.findall(r"\S+", s))
    return (1 - 0.5 * i / n) * (0.8 if w > 50 else 0.5 if w < 4 else 1.0)


def test_category_summaries(spark):
    """By plain ranking, and the same however the table is cut."""
    docs = rows(spark, "documents")
    want = {}
    for source in {r["source"] for r in docs}:
        mine = [(r["doc_id"], pieces(r["text"] or "")) for r in docs if r["source"] == source]
        best = sorted((-round(weight(s, i, len(p)), 12), k, i, s) for k, p in mine for i, s in enumerate(p))[:2]
        want |= {(source, n + 1): (k, s) for n, (_, k, _, s) in enumerate(best)}
    for parts in (1, 50):
        table = spark.read.parquet(f"{SF}/documents.parquet").repartition(parts)
        got = su.by_category(table, "source", "text").collect()
        assert {(r["category"], r["rank"]): (r["doc_id"], r["sentence"]) for r in got} == want


def plain_running(batches, n=3):
    state = {}
    for batch in batches:
        for key, texts in batch.items():
            every = [s for t in [state.get(key, ("", 0))[0], *texts] for s in (x.strip(" ") for x in re.split(r"(?<=[.!?])\s+", t)) if s]
            best = sorted((-weight(s, i, len(every)), i) for i, s in enumerate(every))[:n]
            state[key] = (" ".join(every[i] for i in sorted(i for _, i in best)), state.get(key, ("", 0))[1] + len(texts))
    return state


def test_running_summaries(spark):
    said = sorted(rows(spark, "conversations"), key=lambda r: (r["conv_id"], r["turn"]))
    batches = [{}, {}]
    for r in said:
        batches[r["turn"] >= 3].setdefault(r["conv_id"], []).append(r["text"] or "")
    got = {r["conv_id"]: (r["summary"], r["sources"]) for r in Q["running_summaries"](spark, SF).collect()}
    assert got == plain_running(batches)


def test_auto_compression(spark):
    """The first strategy within the budget, by each strategy's own output."""
    said = spark.read.parquet(f"{SF}/conversations.parquet")
    from tarnfold.operators import conversation as cv

    total = lambda df, c: {r["conv_id"]: r["t"] for r in df.groupBy("conv_id").agg(F.sum(cv.n_tokens(F.col(c))).alias("t")).collect()}
    before = total(said, "text")
    after = {s: total(su.compressed(said, s, 120), "content") for s in su.STRATEGIES}
    for r in Q["auto_compression"](spark, SF).collect():
        c = r["conv_id"]
        want = "none" if before[c] <= 120 else next((s for s in su.STRATEGIES if after[s].get(c, 0) <= 120), su.STRATEGIES[-1])
        assert (r["strategy"], r["tokens_before"]) == (want, before[c])
        assert r["tokens"] == (before[c] if want == "none" else after[want].get(c, 0))


def test_critical_lines_survive_every_strategy(spark):
    df = spark.createDataFrame([(1, t, "user", f"[CRITICAL] keep {t}" if t == 2 else "some words that say nothing much") for t in range(1, 30)], "conv_id int, turn int, role string, text string")
    for s in su.STRATEGIES:
        assert [r["content"] for r in su.compressed(df, s, 20).where("turn = 2").collect()] == ["[CRITICAL] keep 2"]


def test_like_values_are_a_low_conflict(spark):
    schema = "a_id int, b_id int, a string, b string, similarity double, a_conf double, b_conf double, a_source string, b_source string, a_trust double, b_trust double"
    pair = lambda a, b: (1, 2, a, b, 0.8, 0.6, 0.7, None, None, None, None)
    got = lambda a, b: [(r["kind"], r["severity"]) for r in cf.conflicts(spark.createDataFrame([pair(a, b)], schema)).collect()]
    assert got("her name is Katharina", "Her name is Katherina") == [("value_conflict", "low")]
    assert got("his age is 25", "his age is 30") == [("value_conflict", "high")]
    assert got("met on 3/4/2024 in the old town", "met on 3/5/2024 in the old town") == [("temporal_conflict", "medium")]
    assert got(None, "x") == [] and ("semantic_contradiction", "medium") in got("it is always so", "it is never so")


def test_consolidation_finds_near_copies_and_merges(spark):
    base = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, base, 0.5), (2, base.upper(), 0.9), (3, base + " more", 0.5), (4, " ".join(base.split()[:52]), 0.4), (5, "nothing alike at all", 1.0)], "id int, content string, confidence double")
    run = cf.consolidate(df)
    assert {r["id"]: r["kept"] for r in run["duplicates"].collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {r["id"]: r["cluster"] for r in run["clusters"].collect()} == {1: 1, 4: 1}
    assert [r["content"] for r in run["merged"].collect()] == [base]
    empty = cf.consolidate(df.limit(0))
    assert cf.report(df.limit(0), empty).first()["advice"] == "Memory store is well-organized. No action needed."


def test_branches(spark):
    df = spark.createDataFrame([("main", False), ("a", False), ("b", True)], "branch string, merged boolean")
    assert {r["branch"] for r in lc.without_branch(df, "b").collect()} == {"main", "a"}
    with pytest.raises(ValueError):
        lc.without_branch(df, "a")
    assert {r["branch"] for r in lc.without_branch(df, "a", force=True).collect()} == {"main", "b"}
    with pytest.raises(ValueError):
        lc.without_branch(df, "main")


def test_weighted_summaries(spark):
    per = {}
    for r in sorted(rows(spark, "documents"), key=lambda r: r["doc_id"]):
        parts = [s for s in (re.sub(r"^\s+|\s+$", "", x) for x in re.split(r"(?<=[.!?])\s+", r["text"])) if len(s) >= 20]
        for i, s in enumerate(parts):
            at, score = i / len(parts), 1.0
            score += 0.5 if at < 0.2 else 0.3 if at > 0.8 else 0.0
            for p, w in su.MATTERS:
                score *= w if re.search(p, s, re.IGNORECASE) else 1.0
            score *= (0.8 if len(s.split()) > 50 else 1.0) * (0.5 + r["doc_id"] % 100 / 100)
            per.setdefault(r["source"], []).append((-round(score, 9), r["doc_id"], i, s))
    want = {(source, k + 1): x[3] for source, found in per.items() for k, x in enumerate(sorted(found)[:5])}
    assert {(r["source"], r["rank"]): r["sentence"] for r in Q["weighted_summaries"](spark, SF).collect()} == want


def test_duplicate_estimate(spark):
    df = spark.createDataFrame([(k, f"a b c d e f g h i j k l m n o p q r s t u{k % 2}") for k in range(30)] + [(100, "something else")], "id int, content string")
    r = cf.estimate(df, sample=1000, threshold=0.9).first()
    same = 15 * 14 // 2 * 2 + 15 * 15
    assert (r["memories"], r["exact"], r["groups"], r["sampled"], r["fuzzy"]) == (31, 28, 2, 31, same) and r["total"] == 28 + same
    assert cf.estimate(df.limit(5)).first()["fuzzy"] == 0 and cf.estimate(df.limit(0)).first()["percent"] == 0
