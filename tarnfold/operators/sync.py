"""Causal application of remote events by vector clocks, and two-way sync of two copies of a table.

Events carry (node, key, clock): clock[node] numbers a node's events without gaps, clock[m] is how many of m's events it had seen.
Nothing is folded one event after the other: what may be delivered is a prefix a node, found by a few aggregates, and what
a key's events come to depends only on those that no other of them has seen, at most one a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.session import cut

#: Nodes up to which the table of prefixes is broadcast.
BROADCAST_NODES = 100_000
POLICIES = ("lww", "fww", "version", "merge", "ours", "theirs", "manual")


def deliverable(events: DataFrame, delivered: DataFrame) -> DataFrame:
    """(node, upto): the last event of each node that may be delivered after ``delivered`` (node, upto), events (node, seq,
    clock): its node's earlier events are there, and so is all that it had seen. Nodes without anything new keep theirs.

    A gap is a number whose successor is missing: an anti-join by (node, number), not a pass over a node's events. Then
    prefixes shrink until nothing in them has seen beyond them: an aggregate a round, at most as many rounds as nodes.
    """
    known = events.select("node").distinct().join(delivered.select("node", F.col("upto").alias("had")), "node", "full_outer").select("node", F.coalesce("had", F.lit(0)).cast("long").alias("had"))
    new = events.select("node", "seq", "clock").join(known, "node").where("seq > had")
    seqs = cut(new.select("node", "seq", "had").distinct())
    ends = seqs.join(seqs.select("node", (F.col("seq") - 1).alias("seq")), ["node", "seq"], "left_anti").groupBy("node").agg(F.min("seq").alias("end"))
    begun = seqs.where("seq = had + 1").select("node")
    ends = ends.join(begun, "node", "left_semi")
    prefix = cut(known.join(ends, "node", "left").select("node", "had", F.coalesce("end", "had").alias("upto")))
    seen = cut(new.select("node", "seq", F.explode("clock").alias("other", "count")).where("other <> node"))
    small = prefix.count() <= BROADCAST_NODES
    while True:
        hint = F.broadcast if small else (lambda df: df)
        limit = prefix.select(F.col("node").alias("other"), F.col("upto").alias("limit"))
        early = seen.join(hint(limit), "other", "left").where(F.col("count") > F.coalesce("limit", F.lit(0))).groupBy("node").agg((F.min("seq") - 1).alias("most"))
        shrunk = cut(prefix.join(early, "node", "left").select("node", "had", F.least("upto", F.greatest("had", F.coalesce("most", "upto"))).alias("upto")))
        if shrunk.join(prefix.select("node", F.col("upto").alias("was")), "node").where("upto < was").isEmpty():
            return shrunk.select("node", "upto")
        prefix = shrunk


def frontier(events: DataFrame, key: str = "key") -> DataFrame:
    """``events`` (key, node, seq, clock, ...) that no other event of their key has seen: at most one a node.

    An event is seen by others where another node's clock has its number, or its node has a later one: two maxima a key
    and node, combined before the shuffle, so a key with any number of events is a few rows a task.
    """
    each = events.select(key, F.col("node").alias("_by"), F.explode("clock").alias("node", "count"))
    most = each.groupBy(key, "node").agg(F.max(F.when(F.col("_by") == F.col("node"), F.col("count"))).alias("_own"), F.max(F.when(F.col("_by") != F.col("node"), F.col("count"))).alias("_other"))
    last = events.join(most, [key, "node"])
    return last.where((F.col("seq") >= F.coalesce("_own", F.lit(0))) & (F.col("seq") > F.coalesce("_other", F.lit(0)))).drop("_own", "_other")


def applied(local: DataFrame, events: DataFrame, policy: str = "lww", me: str = "local", key: str = "key") -> DataFrame:
    """(key, content, confidence, tags, version, created_at, updated_at, clock, winner, candidates) of every key after
    ``events``; both tables have (key, node, seq, clock, content, confidence, tags, version, created_at, updated_at).

    Of the events that no other has seen, the local row among them: one is the result, or else they are in conflict. lww: the
    latest; fww: the one created first; version: the highest; ours: the local row, else the latest; theirs: the latest
    remote one; merge: where contents agree, tags united, the highest confidence and version plus one, else the latest;
    manual: the local row stays where it can, 'open' is the winner. Ties: the later update, then the smaller node. Clocks
    are the maxima of all events of the key.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    cols = ["content", "confidence", "tags", "version", "created_at", "updated_at"]
    every = local.select(key, "node", "seq", "clock", *cols).unionByName(events.select(key, "node", "seq", "clock", *cols)).dropDuplicates([key, "node", "seq"])
    clocks = every.select(key, F.explode("clock").alias("n", "c")).groupBy(key, "n").agg(F.max("c").alias("c")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "c")))).alias("clock"))
    last = frontier(every, key)
    mine = (F.col("node") == me).cast("int")
    late = [F.desc("updated_at"), F.asc("node")]
    order = {
        "lww": late, "merge": late,
        "fww": [F.asc("created_at"), *late],
        "version": [F.desc("version"), *late],
        "ours": [mine.desc(), *late], "manual": [mine.desc(), *late],
        "theirs": [mine.asc(), *late],
    }[policy]
    ranked = last.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))  # a row a node and key at most
    same = F.count_if(F.col("content").isNull()) == 0
    per = ranked.groupBy(key).agg(
        F.min_by(F.struct("node", *cols), "_r").alias("p"),
        F.count("*").alias("candidates"),
        (same & (F.min("content") == F.max("content"))).alias("alike"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("all_tags"),
        F.max("confidence").alias("most"), F.max("version").alias("last"), F.min("created_at").alias("first"),
    )
    merged = (F.lit(policy == "merge")) & F.col("alike") & (F.col("candidates") > 1)
    either = lambda then, name: F.when(merged, then).otherwise(F.col(f"p.{name}")).alias(name)
    winner = F.when(merged, "merged").when(F.lit(policy == "manual") & (F.col("candidates") > 1), "open").otherwise(F.col("p.node"))
    out = per.select(
        key, F.col("p.content").alias("content"), either(F.col("most"), "confidence"), either(F.col("all_tags"), "tags"), either(F.col("last") + 1, "version"),
        either(F.col("first"), "created_at"), F.col("p.updated_at").alias("updated_at"), winner.alias("winner"), F.col("candidates").cast("int").alias("candidates"),
    )
    return out.join(clocks, key)


def apply_remote_events(local: DataFrame, events: DataFrame, delivered: DataFrame, policy: str = "lww", me: str = "local", key: str = "key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, held back, delivered): what the deliverable events make of ``local``, the events that wait for a gap to close
    or for what they had seen, and the merged clock as (node, upto). Repeated events count once; ``local`` rows carry
    node ``me``, whose numbers no remote clock has to wait for: what a remote node has seen of us, we have."""
    upto = deliverable(events.withColumn("clock", F.map_filter("clock", lambda n, c: n != me)).select("node", "seq", "clock"), delivered)
    had = delivered.select("node", F.col("upto").alias("_had"))
    marked = cut(events.join(upto, "node").join(had, "node", "left").withColumn("_late", F.col("seq") > F.col("upto")))
    ready = marked.where(~F.col("_late") & (F.col("seq") > F.coalesce("_had", F.lit(0))))
    return applied(local, ready, policy, me, key), marked.where("_late").select(*events.columns), upto


SYNC = ("latest", "ours", "theirs", "merge", "manual")


def two_way_sync(local: DataFrame, remote: DataFrame, policy: str = "latest", me: str = "local", key: str = "key") -> DataFrame:
    """Pull, then push, of tables (key, content, confidence, tags, agent, version, created_at, updated_at, clock map): the
    state after it, with ``action`` (inserted, taken, kept, remote, local, merged or conflict) and whether it is ``pushed``.

    A row that only one side has goes to the other. Different versions by different agents conflict: latest takes the later
    update, the local one if equal; merge joins rows of one content (united tags, highest confidence, the versions' maximum
    plus one, the earlier creation, merged clocks with one more for ``me``) and leaves others open, as manual does.
    Without a conflict the higher version is taken. Rows are pushed whose version is above the remote one's, or that it
    lacks; where manual leaves conflicts open, nothing is pushed at all.
    """
    if policy not in SYNC:
        raise ValueError(f"unknown policy {policy!r}")
    cols = ["content", "confidence", "tags", "agent", "version", "created_at", "updated_at", "clock"]
    pack = lambda df, n: df.select(key, F.struct(*cols).alias(n))
    both = pack(local, "a").join(pack(remote, "b"), key, "full_outer")
    a, b = F.col("a"), F.col("b")
    conflict = (a["version"] != b["version"]) & ~a["agent"].eqNullSafe(b["agent"])
    alike = a["content"].eqNullSafe(b["content"])
    resolved = {
        "latest": F.when(b["updated_at"] > a["updated_at"], "remote").otherwise("local"),
        "ours": F.lit("local"), "theirs": F.lit("remote"),
        "merge": F.when(alike, "merged").otherwise("conflict"), "manual": F.lit("conflict"),
    }[policy]
    action = F.when(a.isNull(), "inserted").when(b.isNull(), "kept").when(conflict, resolved).when(b["version"] > a["version"], "taken").otherwise("kept")
    rows = both.withColumn("action", action)
    theirs = F.col("action").isin("inserted", "taken", "remote")
    merged = F.col("action") == "merged"
    clock = F.map_zip_with(a["clock"], b["clock"], lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    own = F.coalesce(F.element_at(clock, F.lit(me)), F.lit(0)) + 1
    clock = F.map_concat(F.map_filter(clock, lambda k, v: k != me), F.create_map(F.lit(me), own.cast("long")))
    special = {
        "confidence": F.greatest(a["confidence"], b["confidence"]), "tags": F.array_sort(F.array_union(a["tags"], b["tags"])), "agent": F.lit(me),
        "version": F.greatest(a["version"], b["version"]) + 1, "created_at": F.least(a["created_at"], b["created_at"]), "updated_at": F.greatest(a["updated_at"], b["updated_at"]), "clock": clock,
    }
    plain = lambda c: F.when(theirs, b[c]).otherwise(a[c])
    out = rows.select(key, *[(F.when(merged, special[c]).otherwise(plain(c)) if c in special else plain(c)).alias(c) for c in cols], "action", b["version"].alias("_known"))
    push = F.col("_known").isNull() | (F.col("version") > F.col("_known"))
    if policy == "manual":
        open_ = out.agg(F.coalesce(F.bool_or(F.col("action") == "conflict"), F.lit(False)).alias("_open"))  # one row
        out = out.crossJoin(F.broadcast(open_))
        push = push & ~F.col("_open")
    return out.withColumn("pushed", push).drop("_known", "_open")
