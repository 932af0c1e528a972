"""Causal delivery and two-way sync against plain loops over events in any order."""

import datetime
import random

import pytest

from tarnfold.operators import sync

T0 = datetime.datetime(2024, 1, 1)
EVENT = "key int, node string, seq long, clock map<string,long>, content string, confidence double, tags array<string>, version int, created_at timestamp, updated_at timestamp"


def history(seed, n=120, nodes=("a", "b", "c")):
    """Nodes write and hear of each other now and then; clocks are what they had seen."""
    rng = random.Random(seed)
    seen = {m: {m: 0} for m in nodes}
    out = []
    for i in range(n):
        m = rng.choice(nodes)
        if rng.random() < 0.4:
            for k, v in seen[rng.choice(nodes)].items():
                seen[m][k] = max(seen[m].get(k, 0), v)
        seen[m][m] += 1
        at = T0 + datetime.timedelta(minutes=rng.randrange(10_000))
        out.append((rng.randrange(6), m, seen[m][m], dict(seen[m]), rng.choice("xyz"), rng.randrange(9) / 10, [rng.choice("pqr")], rng.randrange(5), at, at + datetime.timedelta(minutes=rng.randrange(100))))
    return out


def deliver(events, had):
    """One after the other: whatever can go, until nothing can."""
    state, left, done = dict(had), list(events), []
    while True:
        ready = [e for e in left if e[2] == state.get(e[1], 0) + 1 and all(v <= state.get(m, 0) for m, v in e[3].items() if m not in (e[1], "local"))]
        if not ready:
            return state, done, left
        for e in ready:
            state[e[1]] = e[2]
            done.append(e)
            left = [x for x in left if (x[1], x[2]) != (e[1], e[2])]


def below(a, b):
    return a != b and all(v <= b.get(m, 0) for m, v in a.items())


def pick(rows, policy):
    last = [e for e in rows if not any(below(e[3], o[3]) for o in rows)]
    mine = lambda e: e[1] == "local"
    order = {"lww": lambda e: (), "merge": lambda e: (), "fww": lambda e: (e[8],), "version": lambda e: (-e[7],), "ours": lambda e: (not mine(e),), "manual": lambda e: (not mine(e),), "theirs": lambda e: (mine(e),)}[policy]
    best = min(last, key=lambda e: (*order(e), -(e[9] - T0).total_seconds(), e[1]))
    clock = {}
    for e in rows:
        for m, v in e[3].items():
            clock[m] = max(clock.get(m, 0), v)
    if policy == "merge" and len(last) > 1 and len({e[4] for e in last}) == 1:
        return best[4], max(e[5] for e in last), sorted({t for e in last for t in e[6]}), max(e[7] for e in last) + 1, "merged", clock
    return best[4], best[5], best[6], best[7], "open" if policy == "manual" and len(last) > 1 else best[1], clock


@pytest.mark.parametrize("policy", sync.POLICIES)
def test_events_out_of_order_with_gaps(spark, policy):
    rng = random.Random(policy)
    events = history(3)
    lost = {("b", 30), ("c", 33)}
    sent = [e for e in events if (e[1], e[2]) not in lost]
    rng.shuffle(sent)
    had = {"a": 3}
    at = T0 + datetime.timedelta(minutes=5000)
    local = [(k, "local", 1, {"local": 1, "a": 20, "b": 12}, "x", 0.9, ["own"], 3, at, at) for k in (0, 2, 7)]
    sent = [e for e in sent if not (e[1] == "a" and e[2] <= 3)]
    table = spark.createDataFrame(sent + sent[:9], EVENT).repartition(3)  # some come twice
    state, held, upto = sync.apply_remote_events(spark.createDataFrame(local, EVENT), table, spark.createDataFrame(list(had.items()), "node string, upto long"), policy)
    clock, done, left = deliver(sent, had)
    assert {r["node"]: r["upto"] for r in upto.collect()} == {m: clock.get(m, 0) for m in "abc"}
    assert {(r["node"], r["seq"]) for r in held.collect()} == {(e[1], e[2]) for e in left} and left and done
    got = {r["key"]: (r["content"], r["confidence"], r["tags"], r["version"], r["winner"], r["clock"]) for r in state.collect()}
    assert got == {k: pick([e for e in done + local if e[0] == k], policy) for k in {e[0] for e in done + local}}


def test_the_rest_is_applied_when_the_gap_closes(spark):
    events = history(4)
    frame = lambda rows: spark.createDataFrame(rows, EVENT)
    nothing = spark.createDataFrame([], "node string, upto long")
    first, held, upto = sync.apply_remote_events(frame([]), frame([e for e in events if (e[1], e[2]) != ("a", 5)]), nothing)
    late = frame([e for e in events if (e[1], e[2]) == ("a", 5)])
    _, still, upto = sync.apply_remote_events(frame([]), held.unionByName(late), upto)
    assert still.count() == 0
    assert {r["node"]: r["upto"] for r in upto.collect()} == {m: max(e[2] for e in events if e[1] == m) for m in "abc"}
    state, held, upto = sync.apply_remote_events(frame([]), frame([]), nothing)
    assert state.count() == held.count() == upto.count() == 0
    with pytest.raises(ValueError):
        sync.applied(frame([]), frame([]), "coin")


SIDE = "key int, content string, confidence double, tags array<string>, agent string, version int, created_at timestamp, updated_at timestamp, clock map<string,long>"


def side(rows):
    return [(k, c, 0.5, ["t", c], agent, v, T0, T0 + datetime.timedelta(days=day), {"far": v, "local": 1}) for k, c, agent, v, day in rows]


@pytest.mark.parametrize("policy,want", [
    ("latest", {1: ("b", 2, "remote", False), 2: ("a", 3, "local", True), 3: ("n", 1, "inserted", False), 4: ("o", 1, "kept", True), 5: ("z", 4, "taken", False), 6: ("s", 3, "remote", False)}),
    ("ours", {1: ("a", 1, "local", False), 2: ("a", 3, "local", True), 3: ("n", 1, "inserted", False), 4: ("o", 1, "kept", True), 5: ("z", 4, "taken", False), 6: ("s", 1, "local", False)}),
    ("theirs", {1: ("b", 2, "remote", False), 2: ("b", 1, "remote", False), 3: ("n", 1, "inserted", False), 4: ("o", 1, "kept", True), 5: ("z", 4, "taken", False), 6: ("s", 3, "remote", False)}),
    ("merge", {1: ("a", 1, "conflict", False), 2: ("a", 3, "conflict", True), 3: ("n", 1, "inserted", False), 4: ("o", 1, "kept", True), 5: ("z", 4, "taken", False), 6: ("s", 4, "merged", True)}),
    ("manual", {1: ("a", 1, "conflict", False), 2: ("a", 3, "conflict", False), 3: ("n", 1, "inserted", False), 4: ("o", 1, "kept", False), 5: ("z", 4, "taken", False), 6: ("s", 1, "conflict", False)}),
])
def test_two_way_sync(spark, policy, want):
    local = side([(1, "a", "me", 1, 1), (2, "a", "me", 3, 5), (4, "o", "me", 1, 1), (5, "y", "x", 2, 1), (6, "s", "me", 1, 1)])
    remote = side([(1, "b", "you", 2, 2), (2, "b", "you", 1, 2), (3, "n", "you", 1, 1), (5, "z", "x", 4, 0), (6, "s", "you", 3, 2)])
    got = sync.two_way_sync(spark.createDataFrame(local, SIDE), spark.createDataFrame(remote, SIDE), policy).collect()
    assert {r["key"]: (r["content"], r["version"], r["action"], r["pushed"]) for r in got} == want
    if policy == "merge":
        six = next(r for r in got if r["key"] == 6)
        assert six["clock"] == {"far": 3, "local": 2} and six["agent"] == "local" and six["tags"] == ["s", "t"]
