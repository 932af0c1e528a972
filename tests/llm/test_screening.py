import hashlib
import math

import numpy as np
import pytest

from tarnfold.llm import screening
from tests import oracle


def plain(rows, k, rounds, scale, dim, seed=2):
    clamp = lambda v: max(-(2**63), min(2**63 - 1, v))
    kept = [(i, [clamp(math.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for j in set(at):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    top = 2**63 - 1
    found = [(i, near(v), far(v, c[near(v)])) for i, v in kept]
    per = {j: sum(min(d, top) for _, a, d in found if a == j) for _, j, _ in found}
    total = sum(per.values())
    return sorted(((i, j, min(d, top), min(per[j], top), min(total, top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int").repartition(3)


def got(spark, rows, k, rounds, scale, dim):
    return sorted((tuple(r) for r in screening.cluster(screening.whole(frame(spark, rows), scale, dim), k, rounds).collect()), key=repr)


def test_intervals_hold_the_exact_score():
    rng = np.random.default_rng(3)
    for size in (1, 1e3, 2**24 + 3, 1e12, 1e16):
        x, c = ((rng.standard_normal((50, 64)) * size).round().clip(-(2.0**62), 2.0**62).astype(np.int64) for _ in range(2))
        low, high = screening.intervals(x, c[:9])
        for i in range(50):
            for j in range(9):
                true = sum(int(b) * int(b) for b in c[j]) - 2 * sum(int(a) * int(b) for a, b in zip(x[i], c[j]))
                assert low[i, j] <= true <= high[i, j]
        assert (high - low).max() < 1e-3 * 64 * max(size, 1) ** 2 * 64


def test_overlapping_intervals_are_settled_by_integers():
    """Centroids one apart far from the origin: float32 can't tell them, integers do; equal ones go to the lowest number."""
    base = np.full(64, 2**26, np.int64)
    c = np.array([base + 2, base + 1, base, base + 1])
    x = np.array([base, base + 1, base + 2, base + 3])
    low, high = screening.intervals(x, c)
    assert (low <= high.min(axis=1, keepdims=True)).all()
    assert screening.nearest(x, c).tolist() == [2, 1, 0, 0]
    assert screening.intervals(np.full((2, 64), 2**62), np.full((2, 64), 2**62)) is None  # float32 could overflow
    huge = np.array([[2**63 - 1] * 64, [-(2**63)] * 64], np.int64)
    assert screening.nearest(huge, huge[::-1]).tolist() == [1, 0]


@pytest.mark.parametrize("seed,k", [(1, 7), (2, 1)])
def test_against_brute_force(spark, seed, k):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((400, 8)).round(2)
    x[100:230] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, []), (402, [1.0] * 7), (403, [None] * 8), (404, [math.nan] * 8), (405, [math.inf] * 8), (None, [0.5] * 8), (3, x[3].tolist()), (3, [9.0] * 8), (406, [-0.001] * 8)]
    assert got(spark, rows, k, 5, 256, 8) == plain(rows, k, 5, 256, 8)


def test_large_components_few_rows_and_none(spark):
    rows = [(i, [1e15 * (i % 3), -1e12 * i]) for i in range(20)] + [(50, [1e300, -1e300])]
    assert got(spark, rows, 4, 3, 256, 2) == plain(rows, 4, 3, 256, 2)
    few = [(1, [0.5, 1.0]), (2, [0.5, 1.0])]
    assert got(spark, few, 40, 5, 256, 2) == plain(few, 40, 5, 256, 2)
    assert got(spark, [(None, [1.0, 2.0])], 40, 5, 256, 2) == [] == got(spark, [(1, None)], 40, 5, 256, 2)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(oracle.connect(sf), screening.op12_screened_clusters(spark, sf), screening.oracle()) is None
