"""Calibration, names and budgets against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import calibration as cal
from tarnfold.operators import consolidation as co
from tarnfold.operators import conversation as cv
from tarnfold.operators import entities as en
from tarnfold.operators import retrieval as rt


def points(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = round(rng.gauss(0, 1), 1 if i % 2 else 4)
        out.append((s, int(rng.random() < 1 / (1 + math.exp(-1.7 * s + 0.4)))))
    return out


def frame(spark, rows):
    odd = [(None, 1), (float("nan"), 1), (float("inf"), 0), (0.5, None)]
    return spark.createDataFrame([(s, y, "z") for s, y in rows + odd], "score double, label int, s string").repartition(3)


def test_platt(spark):
    rows = points()
    s, y = (np.array(c, float) for c in zip(*rows))
    a, b = cal.fit_platt(frame(spark, rows))
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert abs(((p - y) * s).sum()) < 1e-6 and abs((p - y).sum()) < 1e-6  # where the likelihood is flat
    assert cal.fit_platt(frame(spark, rows), method="gradient", steps=20) == pytest.approx(rt.fit_platt(s, y, steps=20))
    assert cal.fit_platt(frame(spark, [])) == (1.0, 0.0)
    one = cal.fit_platt(frame(spark, [(2.0, 1), (2.0, 0), (2.0, 0), (2.0, 0)]))
    assert 1 / (1 + math.exp(-(one[0] * 2 + one[1]))) == pytest.approx(0.25)
    assert all(map(math.isfinite, cal.fit_platt(frame(spark, [(-1.0, 0), (1.0, 1)] * 5))))


def plain_isotonic(rows):
    per = {}
    for s, y in rows:
        n, t = per.get(s, (0, 0))
        per[s] = n + 1, t + y
    keys = sorted(per)
    n, y = (np.cumsum([0] + [per[k][i] for k in keys]) for i in (0, 1))
    return {k: max(min((y[e + 1] - y[b]) / (n[e + 1] - n[b]) for e in range(i, len(keys))) for b in range(i + 1)) for i, k in enumerate(keys)}


@pytest.mark.parametrize("seed,fan", [(1, 16), (2, 2)])
def test_isotonic(spark, monkeypatch, seed, fan):
    monkeypatch.setattr(cal, "FAN", fan)
    rows = points(300, seed)
    want = plain_isotonic(rows)
    blocks = cal.fit_isotonic(frame(spark, rows))
    found = sorted(blocks.collect(), key=lambda r: r["low"])
    assert all(a["value"] < b["value"] and a["high"] < b["low"] for a, b in zip(found, found[1:])) and sum(r["n"] for r in found) == len(rows)
    x, y = [v for r in found for v in (r["low"], r["high"])], [r["value"] for r in found for _ in range(2)]
    asked = sorted(want) + [-9.0, 9.0, None, float("nan")] + [(a + b) / 2 for a, b in zip(x, x[1:])]
    got = cal.isotonic(spark.createDataFrame([(v,) for v in asked], "score double"), blocks).collect()
    assert len(got) == len(asked)
    for r in got:
        if r["score"] is None or r["score"] != r["score"]:
            assert r["calibrated"] is None
        else:
            assert r["calibrated"] == pytest.approx(np.interp(r["score"], x, y))
            assert r["score"] not in want or r["calibrated"] == pytest.approx(want[r["score"]])


def test_isotonic_ends(spark):
    none = cal.isotonic(spark.createDataFrame([(1.0,)], "score double"), cal.fit_isotonic(frame(spark, [])))
    assert none.first()["calibrated"] is None
    one = cal.isotonic(spark.createDataFrame([(1.0,), (5.0,)], "score double"), cal.fit_isotonic(frame(spark, [(2.0, 1), (2.0, 0)])))
    assert [r["calibrated"] for r in one.collect()] == [0.5, 0.5]
    assert cal.fit_minmax(spark.createDataFrame([(1.0,), (5.0,)], "score double")) == (1.0, 5.0)
    shown = spark.createDataFrame([(2.0,)], "score double").select(cal.minmax(F.col("score"), (1.0, 5.0)).alias("a"), cal.minmax(F.col("score"), (1.0, 1.0)).alias("b")).first()
    assert tuple(shown) == (0.25, 0.5)


def spellings(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 14))) for _ in range(n)]
    out = set(base) | {"", "a", "b", "ab", "ba", "😀x", "😀xy"}
    for t in base:
        i = rng.randrange(len(t) + 1)
        out.add(t[:i] + rng.choice("abz") + t[i:])
        out.add(t[:i] + t[i + 1 :])
        out.add(t[: max(0, i - 1)] + t[i : i + 1] + t[max(0, i - 1) : i] + t[i + 1 :])
    return sorted(out)


def test_jaro_winkler_of_many():
    names = spellings(60, 1)
    pairs = [(a, b) for a in names[:80] for b in names]
    assert en.jaro_winkler(*map(list, zip(*pairs))) == pytest.approx([co.jaro_winkler(a, b) for a, b in pairs])


@pytest.mark.parametrize("threshold", [0.83, 0.92, 0.97])
def test_similar_names_lose_no_pair(spark, threshold):
    names = spellings(70, 2)
    rows = [(i, "ab"[i % 7 == 0], n, 1) for i, n in enumerate(names)] + [(9999, "a", None, 1)]
    got = {(r["a"], r["b"]) for r in en.similar_names(spark.createDataFrame(rows, "id long, type string, name string, key int").repartition(3), threshold).collect()}
    want = {(i, j) for i, s, a, _ in rows[:-1] for j, t, b, _ in rows[:-1] if i < j and s == t and a and b and co.jaro_winkler(a, b) >= threshold}
    assert got == want and want
    with pytest.raises(ValueError):
        en.similar_names(spark.createDataFrame(rows, "id long, type string, name string, key int"), 0.8)


@pytest.mark.parametrize("threshold", [0.96, 0.985])
def test_close_names_lose_no_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(en, "LIST", 7, raising=False)
    monkeypatch.setattr(en, "BUCKET", 50, raising=False)
    names = spellings(70, 4) + [f"customer#{i * 37 % 1000:09d}" for i in range(250)]
    rows = [(i, "ab"[i % 7 == 0], n) for i, n in enumerate(names)] + [(9999, "a", None), (9998, None, names[0])]
    got = [(r["a"], r["b"]) for r in en.similar_names(spark.createDataFrame(rows, "id long, type string, name string").repartition(3), threshold).collect()]
    want = {(i, j) for i, s, a in rows[:-2] for j, t, b in rows[:-2] if i < j and s == t and a and b and abs(len(a) - len(b)) < 9 and co.jaro_winkler(a, b) >= threshold - 1e-12}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_keys_of_close_names_hold_all_letters_of_equal_lengths():
    # 18 letters at 0.985: nothing less than all of them, so numbered names share a key only as anagrams
    assert (18, 18, 18) in en._by_lengths(en.needed(0.985), [17, 18])[18]


def test_resolving(spark):
    rows = [(5, "p", "Martha Jones"), (3, "p", "marhta jones "), (9, "p", "Martha Jones"), (4, "c", "Martha Jones"), (1, "p", None), (2, "p", None), (7, "p", "Somebody Else")] + [(100 + i, "p", "Hot Name") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, type string, name string")
    led = en.resolve(df)
    got = {r["id"]: r["entity"] for r in led.collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 4, 1: 1, 2: 2, 7: 7} | {100 + i: 100 for i in range(300)}
    assert {(r["entity"], r["alias"], r["mentions"]) for r in en.aliases(df, led).collect()} == {(3, "Martha Jones", 2), (3, "marhta jones ", 1), (4, "Martha Jones", 1), (7, "Somebody Else", 1), (100, "Hot Name", 300)}
    assert en.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [5, 60, 150, 400, 10**6])
def test_budgets_are_kept(spark, budget):
    rng = random.Random(budget)
    talk = [(c, t, rng.choice(["system", "user", "user", "assistant"]), " ".join(rng.choice(["it is 42 now.", "we decided that all is well.", "some words that mean nothing at all!", "[KEY] keep this"]) for _ in range(rng.randrange(0, 8)))) for c in range(6) for t in range(rng.randrange(1, 14))]
    talk.append((0, 99, None, None))
    df = spark.createDataFrame(talk, "conv_id int, turn int, role string, text string")
    got = cv.tiered_budget(df, budget, 2, 3).collect()
    size = {(r["conv_id"], r["turn"]): r["n"] for r in df.select("conv_id", "turn", cv.n_tokens(F.col("text")).alias("n")).collect()}
    for c in range(6):
        mine = [r for r in got if r["conv_id"] == c]
        assert sum(r["tokens"] for r in mine) <= budget and len({r["turn"] for r in mine}) == len(mine)
        whole = sum(n for (conv, _), n in size.items() if conv == c) <= budget
        assert {r["tier"] for r in mine} <= ({"whole"} if whole else {"system", "recent", "old", "medium"})
        if not whole:
            # system messages from the first on, as far as they fit
            used, want = 0, []
            for _, t, role, _ in sorted((m for m in talk if m[0] == c and m[2] == "system"), key=lambda m: m[1]):
                if used + size[c, t] > budget:
                    break
                used += size[c, t]
                want.append(t)
            assert sorted(r["turn"] for r in mine if r["tier"] == "system") == want
            assert sum(r["tokens"] for r in mine if r["tier"] == "old") <= budget // 4
            assert sum(r["tokens"] for r in mine if r["tier"] in ("old", "medium")) <= budget // 4 + budget // 3
