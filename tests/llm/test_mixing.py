import hashlib
import math
import re
from collections import defaultdict

import pytest

from tarnfold.llm import mixing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")


ROWS = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}", "x") for i in range(400)] + [(400, None, None, "x"), (401, "", "big", "x"), (7, "w " * 1, "big", "x"), (402, "w " * 5000, "s1", "x")]


def brute(rows, seed=17, **target):
    tokens = defaultdict(int)
    for _, t, s, _ in rows:
        tokens[s or ""] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(tokens.values())
    a = mixing.bisect_exponent(tokens, budget=total, **target)
    w = mixing.weights_at(tokens, a)
    copies = defaultdict(list)
    for s, n in tokens.items():
        b = round(total * w[s])
        own = sorted((int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16), i, len((t or "").split())) for i, t, x, _ in rows if (x or "") == s)
        at = 0
        for _, i, k in own:
            copies[i].append((b // n if n else 0) + (at < (b % n if n else 0)))
            at += k
    return a, {k: sorted(v) for k, v in copies.items()}


@pytest.mark.parametrize("target", [dict(target_entropy=0.95, max_repeats=4.0), dict(target_entropy=None, max_repeats=2.0), dict(target_entropy=1.0, max_repeats=None)])
def test_mix_against_brute_force(spark, target):
    got = mixing.mix(table(spark, ROWS), **target).collect()
    assert len(got) == len(ROWS)
    a, copies = brute(ROWS, **target)
    seen = defaultdict(list)
    for r in got:
        assert math.isclose(r["exponent"], a)
        seen[r["doc_id"]].append(r["copies"])
    assert {k: sorted(v) for k, v in seen.items()} == copies


def test_repetition_limit():
    tokens = {"a": 10**9, "b": 1000, "c": 10}
    a = mixing.bisect_exponent(tokens, max_repeats=3.0)
    w = mixing.weights_at(tokens, a)
    assert all(sum(tokens.values()) * w[s] <= 3.0 * n * (1 + 1e-9) for s, n in tokens.items()) and 0 < a < 1
    a = mixing.bisect_exponent(tokens, target_entropy=0.9)
    assert math.isclose(mixing.entropy(mixing.weights_at(tokens, a)), 0.9 * math.log(3), rel_tol=1e-6)


def test_empty_and_blank(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r["copies"] for r in mixing.mix(table(spark, [(1, None, None, "x"), (2, "  ", "a", "x")])).collect()] == [0, 0]
