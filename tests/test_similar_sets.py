"""Near pairs of word sets: none lost, and chance meetings are no candidates."""

import random

import numpy as np

from tarnfold.operators import consolidation as co


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.sample([f"w{j}" for j in range(400)], rng.choice([1, 2, 3, 5, 9, 20, 40]))
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):  # copies with some words gone, some new, some said twice
            copy = [w for w in words if rng.random() > 0.08] + [f"x{rng.randrange(50)}" for _ in range(rng.randrange(3))] + words[:1]
            out.append(" ".join(copy))
    return out + ["", "  ", "one", "one one", "ONE  one one"]


def test_near_pairs_lose_none(spark, monkeypatch):
    monkeypatch.setattr(co, "TOGETHER", 3)
    monkeypatch.setattr(co, "BUCKET", 20)
    for threshold in (0.5, 0.8):
        rows = list(enumerate(texts(60, 3)))
        got = {(r["a"], r["b"]): r["similarity"] for r in co.near_pairs(spark.createDataFrame(rows + [(9999, None)], "doc_id long, text string").repartition(3), threshold).collect()}
        one = {}
        for i, t in rows:
            one.setdefault(" ".join(t.lower().split()), i)
        sets = [(i, set(t.split())) for t, i in one.items() if t]
        want = {(min(i, j), max(i, j)): len(a & b) / len(a | b) for i, a in sets for j, b in sets if i < j and len(a & b) / len(a | b) >= threshold - 1e-12}
        assert got.keys() == want.keys() and len(want) > 40
        assert all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_one_shared_rare_word_is_no_candidate(spark):
    # 40 texts of 50 words share one word, the rarest that another row has; 40 near copies share nearly all
    apart = [(i, [7] + [1000 + i * 50 + j for j in range(49)]) for i in range(40)]
    near = [(100 + i, [200_000 + j for j in range(50) if j != i]) for i in range(40)]
    hashed = np.random.default_rng(1).integers(-(2**63), 2**63, 300_000)
    sets = spark.createDataFrame([(i, [int(hashed[x]) for x in w]) for i, w in apart + near], "id long, h array<long>")
    got = {(r["a"], r["b"]) for r in co._set_candidates(sets, 0.8).collect()}
    assert got == {(100 + i, 100 + j) for i in range(40) for j in range(i + 1, 40)}

