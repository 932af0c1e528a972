import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tarnfold.llm import jaccard
from tarnfold.operators.components import connected_components


def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(size, len(w))
        out.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    return out


def brute(rows, size=4, per=85):
    sets = sets_of(rows, size)
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= per * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def made(seed, n=240, family=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = text(60)
    rows = [None, "", " \t", "one", "One", "two words", "two  WORDS", "a b c", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(n):
        base = text(rng.choice([5, 30, 80, 200]))
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            near = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                near[rng.randrange(len(near))] = "x" + rng.choice(vocab)
            rows.append(" ".join(near))
        if rng.random() < 0.2:
            rows.append(" ".join(passage + text(rng.choice([3, 8, 12, 40]))))
    base = text(150)
    for k in range(family):  # a chain of drifting copies: neighbours link, ends do not
        base[rng.randrange(len(base))] = f"y{k}"
        rows.append(" ".join(base))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,block,hood,rounds", [(1, 128, 4096, 2), (2, 7, 4096, 0), (3, 16, 10, 1)])
def test_against_brute_force(spark, monkeypatch, seed, block, hood, rounds):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    monkeypatch.setattr(jaccard, "HOOD_DOCS", hood)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component string").repartition(5)
    got = sorted(tuple(r) for r in jaccard.link_documents(df).collect())
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 40


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (None, "a b c d e"), (3, None)], "doc_id long, text string")
    got = sorted((r[0] or 0, r[1], r[2] or 0) for r in jaccard.link_documents(df).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert jaccard.link_documents(df.limit(0)).count() == 0


def test_several_texts_of_one_id(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "k l m n o p q r"
    df = spark.createDataFrame([(5, a), (5, b), (2, b), (9, a), (None, c), (None, c), (7, c), (7, a), (8, "none of these at all")], "doc_id long, text string")
    got = sorted((r[0] or 0, r[1], r[2] or 0) for r in jaccard.link_documents(df).collect())
    assert got == [(0, 5, 0), (0, 5, 0), (2, 5, 2), (5, 5, 2), (5, 5, 2), (7, 5, 2), (7, 5, 2), (8, 2, 8), (9, 5, 2)]


def test_a_null_id_links_nothing(spark):
    words = [f"w{k}" for k in range(60)]
    near = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    # 1 and 2 are near the text without an id, not near each other
    df = spark.createDataFrame([(1, near(0, 1)), (None, near()), (2, near(58, 59))], "doc_id long, text string")
    assert sorted((r[0] or 0, r[2] or 0) for r in jaccard.link_documents(df, threshold=0.92).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_shingles_of_equal_low_bits_stay_apart(monkeypatch):
    """32 low bits in common, and the bucket too: still other shingles."""
    sets = {"a": np.array([(k << 40) + 7 for k in range(1, 11)], np.uint64), "b": np.array([(k << 40) + 7 for k in range(6, 16)], np.uint64)}
    monkeypatch.setattr(jaccard, "shingles", lambda text, size: sets[text])
    batch = pa.record_batch({"uid": pa.array([1, 2], pa.int64()), "text": ["a", "b"]})
    blobs = pa.Table.from_batches(list(jaccard._blobs(4, 2)([batch])))
    parts = [jaccard._shared(1)(blobs.filter(pa.compute.equal(blobs["bucket"], b))) for b in set(blobs["bucket"].to_pylist())]
    out = jaccard._assembled(3, 10)(pa.concat_tables(parts))
    assert out["n"].to_pylist() == [10, 10]
    assert [jaccard.sums(jaccard.unpack(x)[0]).tolist() for x in out["codes"].to_pylist()] == [[(k << 40) + 7 for k in range(6, 11)]] * 2


def test_pack():
    rng = np.random.default_rng(1)
    ids = np.sort(rng.integers(-(2**63), 2**63 - 1, 100))
    n = rng.integers(0, 2**32, 7).astype(np.uint32)
    a, b, c = jaccard.unpack(jaccard.pack(jaccard.gaps(ids), n, np.empty(0, np.uint64)))
    assert (jaccard.sums(a, np.int64) == ids).all() and (b == n).all() and len(c) == 0


def test_keep_one(spark):
    rows = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (9, "other words are here now"), (2, None), (1, "")]
    df = spark.createDataFrame([(i, t, "s", "g", 1, "h") for i, t in rows], "doc_id long, text string, source string, _gone string, uid int, h string")
    got = jaccard.keep_one(df)
    assert got.columns == df.columns and sorted(r[0] for r in got.collect()) == [1, 2, 3, 9]


@pytest.mark.parametrize("seed", range(30))
def test_divide_skip(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(60), rng.randrange(0, 50))) for _ in range(rng.randrange(0, 25))]
    need = rng.randrange(1, 15)
    counts = {x: sum(x in s for s in lists) for x in range(60)}
    assert jaccard.divide_skip(lists, need) == {x: c for x, c in counts.items() if c >= need}


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(5, 5), (None, 1)]
    up = {x: x for e in edges if None not in e for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
