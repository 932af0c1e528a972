"""Stateful streams: restarts, rows out of order, hooks, all displacement strategies."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tarnfold.plans.consolidate import _folder
from tarnfold.streaming import jobs, stateful

SCHEMA = "key long, ts timestamp, tie long, item string, priority double"
START = datetime.datetime(2024, 3, 1)


def rows(n=160, seed=1):
    rng = random.Random(seed)
    return [(k % 3, START + datetime.timedelta(seconds=rng.randrange(0, 7200)), k, f"i{rng.randrange(14)}", rng.randrange(10) / 10) for k in range(n)]


def streamed(spark, batches, processor, hooks=(), late="3 hours", restart=True):
    """Each batch is a file; with ``restart`` the query ends and starts again after every one."""
    folder = _folder(spark, "in")
    out = _folder(spark, "out")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if restart or i == len(batches) - 1:
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
            stateful.run(stateful.stateful(source, processor, late), out + "/rows", out + "/progress", hooks)
    return jobs.appended(spark, out + "/rows").collect()


def by_key(batches, late_seconds=10800):
    """Rows that the last watermark has passed, in order."""
    every = [r for b in batches for r in b if r[0] is not None]
    mark = max(stateful.micros(r[1]) for r in every) // 1000 - late_seconds * 1000
    out = {}
    for r in sorted(every, key=lambda r: (r[1], r[2])):
        if stateful.micros(r[1]) // 1000 < mark:
            out.setdefault(r[0], []).append(r)
    return out


def plain_set(batches, capacity, strategy):
    out = []
    for key, mine in by_key(batches).items():
        held = []
        for _, ts, _, item, priority in mine:
            out += [(key, ts, change, which, item) for change, which in stateful.added(held, item, stateful.micros(ts), priority, capacity, strategy)]
            assert len(held) <= capacity
    return sorted(out, key=repr)


@pytest.mark.parametrize("strategy", ["combined", "least_recent"])
def test_working_set_over_restarts(spark, strategy):
    data = rows()
    batches = [data[:60], data[60:61], data[61:] + [(None, START, 1, "x", 0.5), (9, START + datetime.timedelta(hours=6), 999, "end", 0.5)]]
    got = streamed(spark, batches, stateful.WorkingSet(4, strategy))
    assert sorted(((r["key"], r["ts"], r["change"], r["item"], r["cause"]) for r in got), key=repr) == plain_set(batches, 4, strategy)
    assert {r["change"] for r in got} == {"in", "out"}


def test_rate_windows_and_hooks(spark):
    data = rows(90, 2)
    batches = [data[:50], data[50:] + [(9, START + datetime.timedelta(hours=6), 999, "end", 0.5)]]
    seen = []
    got = streamed(spark, batches, stateful.RateWindows(3, 600), (lambda df, number: seen.append((number, df.where("not allowed").count())),), restart=False)
    want = []
    for key, mine in by_key(batches).items():
        window = None
        for _, ts, tie, _, _ in mine:
            window, ok = stateful.allowed(window, stateful.micros(ts), 3, 600_000_000)
            want.append((key, tie, ok, 3 - window[1]))
    assert sorted((r["key"], r["tie"], r["allowed"], r["remaining"]) for r in got) == sorted(want)
    assert sum(n for _, n in seen) == sum(not ok for *_, ok, _ in want) > 0


def test_batching_does_not_matter(spark):
    data = rows(60, 3) + [(9, START + datetime.timedelta(hours=6), 999, "end", 0.5)]
    one = streamed(spark, [data], stateful.WorkingSet(3, "oldest"))
    many = streamed(spark, [data[:20], data[20:40], data[40:]], stateful.WorkingSet(3, "oldest"), restart=False)
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and one


def test_displacement():
    held = [{"item": "a", "added": 0, "used": 50, "priority": 0.9, "activation": 0.1}, {"item": "b", "added": 10, "used": 10, "priority": 0.5, "activation": 1.0}, {"item": "c", "added": 20, "used": 60, "priority": 0.1, "activation": 1.0}]
    assert [stateful.displacement(held, 100, s) for s in ("oldest", "lowest_priority", "least_recent")] == [0, 2, 1]
    assert stateful.displacement(held, 100, "combined") == 2
    with pytest.raises(ValueError):
        stateful.WorkingSet(3, "newest")


def test_session_conf_is_put_back(spark):
    before = spark.conf.get(stateful.PROVIDER, None)
    streamed(spark, [rows(5)], stateful.RateWindows(1, 60))
    assert spark.conf.get(stateful.PROVIDER, None) == before
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_rows_wait_packed(spark):
    """A row goes over in one cell, and a batch in which nothing is due is appended without reading what waits."""

    class Lists:
        def __init__(self):
            self.rows, self.reads = [], 0

        def get(self):
            self.reads += 1
            return iter(self.rows)

        def appendList(self, more):
            self.rows += more

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.timers, self.states = set(), []

        def getListState(self, *_):
            return self.states.append(Lists()) or self.states[-1]

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    class Kept(stateful.InOrder):
        def fold(self, key, rows):
            yield from rows

    class Mark:
        def __init__(self, mark):
            self.getCurrentWatermarkInMs = lambda: mark

    made = [(1, START, 5, "a=\x1fb", 0.1), (1, START, None, None, None), (1, START, 7, "", float("inf"))]
    df = spark.createDataFrame(made, SCHEMA).select(stateful._one("ts", "tie", "item", "priority").alias("row"))
    at = stateful.micros(START)
    assert [stateful._unpacked(r["row"]) for r in df.collect()] == [(at, 5, "a=\x1fb", 0.1), (at, None, None, None), (at, 7, "", float("inf"))]
    handle, p = Handle(), Kept()
    p.init(handle)
    row = lambda ms, tie: {"row": f"{ms * 1000}\x1f{tie}\x1f0.5\x1f=x"}
    waiting = handle.states[0]
    for n in range(20):
        assert not list(p.handleInputRows((1,), iter([row(900 - n, n), row(950, n)]), Mark(10)))
    assert waiting.reads == 0 and len(waiting.rows) == 20 and handle.timers == {881}
    due = list(p.handleExpiredTimer((1,), Mark(890), None))
    assert [r[0] // 1000 for r in due] == list(range(881, 890)) and handle.timers == {890} and len(waiting.rows) == 1
    due = list(p.handleInputRows((1,), iter([row(895, 99)]), Mark(2000)))
    assert len(due) == 32 and due == sorted(due, key=lambda r: r[:2]) and not waiting.rows


def test_results_travel_as_lists():
    """Changes of a key leave in a row of lists, and a timer that Spark says has expired is neither listed nor deleted."""

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Waiting:
        rows = [(stateful.pickle.dumps([(k * 1000, k, f"i{k}", 0.5) for k in range(30)], 5),)]

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

    class Handle:
        registered = []

        def getListState(self, *_):
            return Waiting()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, t):
            self.registered.append(t)

    class Mark:
        def getCurrentWatermarkInMs(self):
            return 20

    p = stateful.WorkingSet(3, "oldest")
    p.init(Handle())
    out = list(p.handleExpiredTimer((1,), Mark(), object()))
    assert len(out) == 1 and out[0]["key"] == 1
    assert list(zip(*out[0][1:]))[:5] == [(0, "in", "i0", "i0"), (1000, "in", "i1", "i1"), (2000, "in", "i2", "i2"), (3000, "out", "i0", "i3"), (3000, "in", "i3", "i3")]
    assert len(out[0]["ts"]) == 20 + 17 and Handle.registered == [20]
