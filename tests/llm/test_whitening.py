import math
from collections import Counter

import numpy as np
import pytest

from tarnfold.llm import whitening


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, whitened double").repartition(4)


def plain(rows, kind=np.float32):
    """By length: exact integers, then the covariance's own eigenvectors."""
    kept = [(i, tuple(math.floor(64 * float(kind(x))) + 1_000_000 for x in v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for d in {len(x) for _, x in kept}:
        mine = [(i, x) for i, x in kept if len(x) == d]
        distinct = sorted({x for _, x in mine})
        n, s = len(distinct), [sum(c) for c in zip(*distinct)]
        y = np.array([[n * a - b for a, b in zip(x, s)] for x in distinct], np.float64) / n
        values, vectors = np.linalg.eigh(y.T @ y / n)
        out[d] = (mine, n, s, values[::-1], vectors[:, ::-1])
    return out


def check(spark, rows, kind="float", real=None):
    x = whitening.integers(frame(spark, rows, kind))
    got = whitening.whitened(x, whitening.fit(x)).collect()
    want = plain(rows, np.float32 if kind == "float" else float)
    size = {r: d for d, (mine, *_) in want.items() for r in mine}
    count = 0
    for d, (mine, n, s, values, vectors) in want.items():
        r = min(16, d) if real is None else real[d]
        for j in range(1, r + 1):
            g = [row for row in got if row["component"] == j and row["n"] == n and row["vec_id"] in {i for i, _ in mine}]
            w = sorted((i, sum((n * a - b) ** 2 for a, b in zip(x, s)), float(np.dot(np.array([n * a - b for a, b in zip(x, s)], np.float64) / n, vectors[:, j - 1]) / math.sqrt(values[j - 1]))) for i, x in mine)
            ours = sorted((row["vec_id"], row["deviation"], row["whitened"]) for row in g)
            count += len(ours)
            assert [o[:2] for o in ours] == [(i, min(v, 2**63 - 1)) for i, v, _ in w]
            a, b = (np.array([v[2] for v in sorted(rows_, key=lambda t: (t[0], t[1]))]) for rows_ in (ours, w))
            assert min(np.abs(np.sort(a) - np.sort(sign * b)).max() for sign in (1, -1)) < 1e-6 * max(1, np.abs(b).max())
            assert all(abs(row["explained"] - values[j - 1] / values.sum()) < 1e-6 and row["identity_error"] < 1e-6 for row in g)
    assert count == len(got) and size


def test_against_eigenvectors_of_the_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 20)) * np.linspace(3, 1, 20)
    x[100:260] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600, None), (601, [None] * 20), (602, [math.nan] * 20), (603, [-math.inf] * 20), (5, x[5].tolist()), (604, [])]
    check(spark, rows)


def test_two_lengths_and_large_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((90, 3)) * [9, 3, 1])]
    rows += [(100 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((70, 5)) * [1e9, 1e8, 5e7, 2e7, 1e7])]
    check(spark, rows, "double")


def test_rank_and_few_rows(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(30)]
    check(spark, line, real={3: 1})
    x = whitening.integers(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert whitening.whitened(x, whitening.fit(x)).collect() == []
    none = whitening.integers(frame(spark, [(1, None)]))
    assert whitening.whitened(none, whitening.fit(none)).collect() == []


def test_the_factor_keeps_digits_that_a_covariance_loses(spark):
    """Deviations 1e8 apart: their squares are further apart than a double's digits."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 2)) * [4e9, 20.0]
    rows = whitening.integers(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "double"))
    model = whitening.fit(rows)[2]
    assert model.error < 1e-4 and len(model.values) == 2
    xs = np.array([[math.floor(64 * a) for a in v] for v in x.tolist()], object)
    slope = sum((a - xs[:, 0].mean()) * b for a, b in xs) / sum((a - xs[:, 0].mean()) ** 2 for a, _ in xs)
    rest = np.array([b - slope * a for a, b in xs], float)
    assert model.values[1] == pytest.approx(rest.var(), rel=1e-6)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    (mine, n, s, values, _), got = plain(rows)[64], whitening.op13_tsqr_whitening(spark, sf).collect()
    deviation = {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in mine}
    assert Counter(r["component"] for r in got) == {j: len(mine) for j in range(1, 17)}
    assert all(r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9 for r in got)
    assert all(abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9 for r in got)
