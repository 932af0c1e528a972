import math
import random

import numpy as np
import pytest

from tarnfold.llm import cover_tree, hilbert


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 3) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)


def made(seed, n=600, d=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[n // 3 : n // 2] = x[0]  # a hot vector
    x[n // 2 : n // 2 + 50] = x[1] + rng.standard_normal((50, d)) * 1e-3
    rows = [(int(i), np.float32(v).tolist()) for i, v in enumerate(x)]
    odd = [(n, None), (n + 100, [None] * d), (n + 200, [math.nan] + [0.0] * (d - 1)), (n + 300, [math.inf] + [0.0] * (d - 1)), (n + 400, [0.0] * d), (None, [1.0] * d), (7, np.float32(x[7]).tolist())]
    return rows + odd


def clean(rows, zero=True):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(y is not None and math.isfinite(y) for y in v) and (zero or any(v))]


def plain_top(ints, every, k):
    """Every row of an id is a candidate, and a query under its id."""
    want = []
    for q in sorted({i for i, _ in ints if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for j, own in ints if j == q for i, v in ints if i != q and len(v) == len(own))[:k]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return want


@pytest.mark.parametrize("seed,block", [(1, 64), (2, 2048)])
def test_cover_tree_against_brute_force(spark, seed, block):
    rows = made(seed) + [(20, [1.0] * 8), (20, [2.0] * 8), (9, [2.0] * 8), (9, [2.0] * 8), (40, [1.0] * 3), (41, [2.0] * 3)]
    table = cover_tree.integers(frame(spark, rows))
    got = sorted(tuple(r) for r in cover_tree.top_k(table, table.where("vec_id % 20 = 0"), 10, data_block=block, query_block=16).collect())
    assert got == plain_top([(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in clean(rows)], 20, 10)


def test_nodes_are_pruned_by_first_scores(spark, monkeypatch):
    """Far clusters: the second round leaves most blocks out, and the result is whole."""
    rng = np.random.default_rng(8)
    x = np.concatenate([c * 50 + rng.standard_normal((200, 6)) for c in rng.standard_normal((6, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = cover_tree.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    met = []
    real = cover_tree.cut
    monkeypatch.setattr(cover_tree, "cut", lambda df: met.append(real(df)) or met[-1])
    out = cover_tree.top_k(table, table.where("vec_id % 100 = 0"), 5, data_block=100, query_block=2)
    assert sorted(tuple(r) for r in out.collect()) == plain_top([(i, [math.floor(1024 * y) for y in v]) for i, v in rows], 100, 5)
    tasks = [df for df in met if df.columns == ["dim", "q_node", "q_sub", "d_node", "d_sub"]]
    blocks = table.count() // 100
    assert len(tasks) == 2 and tasks[1].count() < 0.5 * blocks * tasks[0].select("q_node", "q_sub").distinct().count()


def test_products_beyond_64_bits(spark):
    table = cover_tree.integers(spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in cover_tree.top_k(table, table.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


def test_cover_tree_prunes_and_covers():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((20, 5)) * 100, 60, axis=0) + rng.standard_normal((1200, 5))
    t = cover_tree.CoverTree(x)
    seen = np.concatenate([p for p in t.points])
    assert sorted(seen.tolist()) == list(range(1200))

    def below(n):
        return np.concatenate([t.points[n]] + [below(c) for c in t.children[n]])

    for n in range(len(t.center)):
        assert np.sqrt(((x[below(n)] - x[t.center[n]]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
        if t.children[n]:
            assert t.center[t.children[n][0]] == t.center[n]


def test_large_integers():
    q, x = np.array([[1 << 30, 3]]), np.array([[1 << 30, 1], [(1 << 30) - 1, 5]])
    (scores, ids), = cover_tree.dual_top_k(np.array([9]), q, np.array([1, 2]), x, 5)
    assert scores.tolist() == [(1 << 60) + 3, (1 << 60) - (1 << 30) + 15] and ids.tolist() == [1, 2]


def test_few_and_none(spark):
    table = cover_tree.integers(frame(spark, [(0, [1.0, 2.0]), (100, [1.0, 2.0])]))
    assert sorted(tuple(r) for r in cover_tree.top_k(table, table).collect()) == [(0, 1, 100, 5 << 20), (100, 1, 0, 5 << 20)]
    assert cover_tree.top_k(table.limit(0), table.limit(0)).count() == 0
    assert hilbert.nearest(frame(spark, [])).count() == 0
    assert [tuple(r) for r in hilbert.nearest(frame(spark, [(0, [1.0, 0.0]), (3, [2.0, 0.0])])).collect()] == [(0, 1, 3, 1.0)]


@pytest.mark.parametrize("bits,dims", [(1, 3), (3, 2), (2, 3)])
def test_hilbert_curve_is_continuous(bits, dims):
    side = 1 << bits
    axes = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
    keys = hilbert.hilbert_keys(axes, bits)
    assert sorted(keys.tolist()) == list(range(side**dims))
    path = axes[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("block", [64, 2048])
def test_neighbours_recall_and_scores(spark, block):
    rows = made(5, n=1500, d=16)
    got = hilbert.nearest(frame(spark, rows), every=10, block=block).collect()
    vs = {i: np.array(np.float32(v), float) for i, v in clean(rows, zero=False)}
    ids = np.array(sorted(vs))
    x = np.array([vs[i] for i in ids])
    norm = np.sqrt((x * x).sum(1))
    want, hit = 0, 0
    per = {}
    for r in got:
        per.setdefault(r["query_id"], []).append(r)
    assert set(per) == {i for i in vs if i % 10 == 0}
    for q, found in per.items():
        s = (x * vs[q]).sum(1) / (norm * np.sqrt((vs[q] ** 2).sum()))
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        true = {int(ids[i]) for i in order}
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and len({r["vec_id"] for r in found}) == 5
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(found, found[1:]))
        for r in found:
            assert abs(r["score"] - s[np.searchsorted(ids, r["vec_id"])]) < 1e-12
        want, hit = want + 5, hit + len(true & {r["vec_id"] for r in found})
    assert hit / want >= 0.9


def test_neighbours_of_repeated_ids(spark):
    """Every row of an id is a candidate, and a query under its id."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 0.1]), (3, [0.1, 1.0]), (3, [0.1, 1.0]), (4, [1.0, 1.0])]
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in hilbert.nearest(frame(spark, rows)).collect())
    high = round(1 / math.sqrt(1.01), 6)
    assert got == [(1, 3, high), (2, 3, high), (3, 3, high), (4, 4, round(math.sqrt(0.5), 6)), (5, 4, round(math.sqrt(0.5), 6))]


def test_random_small(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for i in range(120)]
    table = cover_tree.integers(frame(spark, rows))
    got = sorted(tuple(r) for r in cover_tree.top_k(table, table.where("vec_id % 30 = 0"), 4, data_block=32).collect())
    assert got == plain_top([(i, [math.floor(1024 * x) for x in v]) for i, v in rows], 30, 4)
