"""Keyed state that a window can't express: a bounded working set with displacement, and rate windows that begin with a
request.

Rows wait in a key's list state until the watermark has passed them and are then folded in the order of event time, so results
don't depend on how rows fall into batches; an event-time timer wakes a key for its next waiting row. Rows later than the watermark
are left out, as in Spark's windows. State lives in RocksDB under the query's checkpoint and survives restarts.
"""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime.datetime(1970, 1, 1)
STRATEGIES = ("oldest", "lowest_priority", "least_recent", "combined")


def micros(t: datetime.datetime) -> int:
    return (t.replace(tzinfo=None) - _EPOCH) // datetime.timedelta(microseconds=1)


# ---------------------------------------------------------------- the folds, one row at a time


def displacement(held: list[dict[str, Any]], at: int, strategy: str) -> int:
    """Place of the item that goes, of items (item, added, used, priority, activation) in the order they came: the first of
    the smallest. combined: 0.4 priority + 0.3 activation + 0.3 / (1 + seconds unused)."""
    value: dict[str, Callable[[dict[str, Any]], float]] = {
        "oldest": lambda i: i["added"],
        "lowest_priority": lambda i: i["priority"],
        "least_recent": lambda i: i["used"],
        "combined": lambda i: 0.4 * i["priority"] + 0.3 * i["activation"] + 0.3 / (1 + (at - i["used"]) / 1e6),
    }
    return min(range(len(held)), key=lambda k: value[strategy](held[k]))


def added(held: list[dict[str, Any]], item: str, at: int, priority: float, capacity: int, strategy: str) -> list[tuple[str, str]]:
    """Puts an item into ``held``; changes come back as (in or out, item). A full set gives one up first; an item that is
    held already is used instead: its activation rises by 0.3, to 1 at most."""
    for i in held:
        if i["item"] == item:
            i["used"], i["activation"] = at, min(1.0, i["activation"] + 0.3)
            return []
    out = [("out", held.pop(displacement(held, at, strategy))["item"])] if len(held) >= capacity else []
    held.append({"item": item, "added": at, "used": at, "priority": priority, "activation": 1.0})
    return [*out, ("in", item)]


def allowed(window: tuple[int, int] | None, at: int, limit: int, size: int) -> tuple[tuple[int, int], bool]:
    """(begin, granted) of a client's window after a request, and whether it was granted. A window begins anew with the first
    request after the last one ended; refused requests don't count."""
    begin, granted = window if window and at - window[0] < size else (at, 0)
    return ((begin, granted + 1), True) if granted < limit else ((begin, granted), False)


# ---------------------------------------------------------------- processors


#: Rows of a packed state value at most: a value a row would cost a conversion and a call each.
PACKED = 10_000


class InOrder(StatefulProcessor):
    """Holds rows (at, tie, ...) back until the watermark is past them; subclasses fold them one at a time. Times are
    microseconds. A key's timer stands at its first waiting row, so a batch that nothing is due in only appends. To list a
    key's timers is a scan of the store, so an expired timer, which Spark deletes itself, is taken as the only one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = [_unpacked(r["row"]) for r in rows]
        yield from self._due(key, came, list(self.handle.listTimers()), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        timers = [] if expiredTimerInfo else list(self.handle.listTimers())
        yield from self._due(key, [], timers, timerValues.getCurrentWatermarkInMs())

    def _due(self, key: Any, came: list[tuple], timers: list[int], mark: int) -> Iterator[Row]:
        first = min([r[0] // 1000 for r in came] + timers, default=mark)
        if came and first >= mark:
            self.waiting.appendList(_packed(came))
        else:
            rows = sorted([r for v in self.waiting.get() for r in pickle.loads(v[0])] + came, key=lambda r: (r[0], r[1]))
            late = [r for r in rows if r[0] // 1000 >= mark]
            due = rows[: len(rows) - len(late)]
            if due:
                yield from self.fold(key, due)
            if late:
                self.waiting.put(_packed(late))
                first = late[0][0] // 1000
            else:
                self.waiting.clear()
                return
        if timers != [first]:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first)

    def fold(self, key: Any, rows: Iterable[tuple]) -> Iterator[Row]:
        """Results: a row of the key and a list a column, as rows go back cell by cell too (``_listed``)."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _one(ts: str, tie: str, item: str, priority: str) -> Column:
    """A row as one string, as Spark hands rows to a processor cell by cell; ``_unpacked`` reads it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("\x1f", F.unix_micros(ts).cast("string"), text(tie), text(priority), F.coalesce(F.concat(F.lit("="), F.col(item)), F.lit("")))


def _unpacked(row: str) -> tuple[int, int | None, str | None, float | None]:
    at, tie, priority, item = row.split("\x1f", 3)
    return int(at), int(tie) if tie else None, item[1:] if item else None, float(priority) if priority else None


def _packed(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[i : i + PACKED], 5),) for i in range(0, len(rows), PACKED)]


def _listed(key: int, names: tuple[str, ...], results: Iterable[tuple]) -> Iterator[Row]:
    """Results of a key as rows of lists, PACKED results a row at most; ``stateful`` makes them rows again."""
    made, results = Row("key", *names), iter(results)
    while part := list(islice(results, PACKED)):
        yield made(key, *map(list, zip(*part)))


class WorkingSet(InOrder):
    """Changes of a key's working set: an item goes before another comes into a full one."""

    OUT, TIMES = {"ts": "long", "change": "string", "item": "string", "cause": "string"}, ("ts",)

    def __init__(self, capacity: int = 7, strategy: str = "combined"):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}")
        self.capacity, self.strategy = capacity, strategy

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "items binary")

    def fold(self, key: Any, rows: Iterable[tuple]) -> Iterator[Row]:
        before = self.held.get()
        held = pickle.loads(before[0]) if before else []
        changes = ((at, change, which, item) for at, _, item, priority in rows for change, which in added(held, item, at, priority, self.capacity, self.strategy))
        yield from _listed(key[0], tuple(self.OUT), changes)
        self.held.update((pickle.dumps(held, 5),))


class RateWindows(InOrder):
    """Whether each request of a client is granted, what is left of its window, and when that ends."""

    OUT, TIMES = {"ts": "long", "tie": "long", "allowed": "boolean", "remaining": "int", "ends": "long"}, ("ts", "ends")

    def __init__(self, limit: int, seconds: int):
        self.limit, self.size = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "begin long, granted int")

    def fold(self, key: Any, rows: Iterable[tuple]) -> Iterator[Row]:
        before = self.window.get()
        window = tuple(before) if before else None

        def granted() -> Iterator[tuple]:
            nonlocal window
            for at, tie, _, _ in rows:
                window, ok = allowed(window, at, self.limit, self.size)
                yield at, tie, ok, self.limit - window[1], window[0] + self.size

        yield from _listed(key[0], tuple(self.OUT), granted())
        if window:
            self.window.update(window)


def stateful(rows: DataFrame, processor: InOrder, late: str = "1 hour") -> DataFrame:
    """``rows`` (key long, ts, tie, item, priority) through a processor; ``late``: how far behind the newest row one may be."""
    fit = rows.select(F.col("key").cast("long"), F.col("ts").cast("timestamp"), F.col("tie").cast("long"), F.col("item").cast("string"), F.col("priority").cast("double"))
    fit = fit.where("key is not null and ts is not null").select("key", "ts", _one("ts", "tie", "item", "priority").alias("row")).withWatermark("ts", late)
    kinds = StructType.fromDDL(", ".join(["key long", *[f"{c} array<{kind}>" for c, kind in processor.OUT.items()]]))
    lists = fit.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=kinds, outputMode="Append", timeMode="EventTime")
    out = lists.select("key", F.inline(F.arrays_zip(*processor.OUT)))
    return out.withColumns({c: F.timestamp_micros(c) for c in processor.TIMES})


def run(df: DataFrame, out: str, checkpoint: str, hooks: tuple[Callable[[DataFrame, int], None], ...] = ()) -> None:
    """Runs to the end of what is there. A batch is a folder of its number in ``out``, so a repeated one changes nothing; then
    each hook is called with the batch and its number: at least once, so a hook has to bear repeats."""
    spark: SparkSession = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        for hook in hooks:
            hook(batch.sparkSession.read.parquet(f"{out}/batch={number}"), number)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
