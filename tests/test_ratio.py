"""difflib's ratio without its time, and the windows that hold unlike texts apart."""

import difflib
import random

from tarnfold.operators import consolidation as co


def made(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def altered(rng, t):
    kind = rng.randrange(4)
    if kind == 0:
        words = t.split()
        rng.shuffle(words)
        return " ".join(words)
    if kind == 1:
        return t[len(t) // 3 :] + t[: len(t) // 3]
    for _ in range(rng.choice((1, 6, 30))):
        at = rng.randrange(len(t))
        t = t[:at] + rng.choice(("", "x", "q 9", "zz")) + t[at + rng.choice((0, 1, 6)) :]
    return t


def texts():
    rng, parts = random.Random(4), ["tion", "er", "th", "an", "wh", "qu", "of", "ly", "k7", "zes", "st"]
    for n in (20, 60, 60, 200, 200):
        t = made(rng, parts, n)
        for one in (t, t[:90] + t[:80] * 4 + "!!" * 9, " ".join(f"{t[:40]} {i % 7}" for i in range(n // 4))):
            for _ in range(4):
                yield one, altered(rng, one)
                yield altered(rng, one), one
    yield "", "ab" * 200
    yield "e" * 300, "e" * 250
    yield "e" * 300 + "z", "e" * 250 + "y"


def test_ratio_is_that_of_difflib(monkeypatch):
    pairs = [(a, b, difflib.SequenceMatcher(None, a, b).ratio()) for a, b in texts()]
    assert sum(len(b) >= co.AUTOJUNK for _, b, _ in pairs) > 60
    assert [co._ratio(a, b) for a, b, _ in pairs] == [r for _, _, r in pairs]
    monkeypatch.setattr(co, "HITS", 50)
    assert [co._ratio(a, b) for a, b, _ in pairs] == [r for _, _, r in pairs]
    monkeypatch.undo()
    monkeypatch.setattr(co.difflib, "SequenceMatcher", None)  # long texts do without it
    for a, b, r in pairs:
        if len(b) >= co.AUTOJUNK:
            matched = round(r * (len(a) + len(b)) / 2)
            assert co._ratio(a, b, None, matched) == r and co._ratio(a, b, co._places(b), matched + 1) == 0.0


def test_matches_leave_windows_in_common():
    some = [p for p in texts() if p[0]]
    left, right = [a for a, _ in some], [b for _, b in some]
    shared = co._shared_windows(co._windows(left), co._windows(right), len(left), len(right))
    found = 0
    for p, (a, b) in enumerate(some):
        blocks = [n for _, _, n in difflib.SequenceMatcher(None, a, b).get_matching_blocks() if n]
        bound = sum(max(n - co.SPAN + 1, 0) for n in blocks)
        assert shared(p)[p] >= bound
        found += bound > 0
    assert found > 60
    rng = random.Random(2)
    one, other = ("".join(rng.choice("abcdefghijklmnop") for _ in range(500)) for _ in range(2))
    assert co._shared_windows(co._windows([one]), co._windows([other, one]), 1, 2)(0).tolist() == [0, 491]
    assert co._shared_windows(co._windows(["short"]), co._windows(["short"]), 1, 1)(0).tolist() == [0]
