"""State of memories over time as expressions and small table operators: salience, consolidation scores, working sets,
branches, source registries, validation, nodes and replicas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def salience(valence: Column, importance: Column, strength: Column) -> Column:
    """0.3 of |valence| / 2, 0.4 of the importance and 0.3 of the strength; valence is from -2 to 2."""
    return F.abs(valence) / 2 * 0.3 + importance * 0.4 + strength * 0.3


def consolidation_score(strategy: str, importance: Column, activation: Column, accesses: Column, valence: Column) -> Column:
    """all, important, frequent, emotional or combined. No valence counts as half, a neutral one (0) as nothing."""
    often = F.least(F.lit(1.0), accesses / 10)
    feeling = F.coalesce(F.abs(valence) / 2, F.lit(0.5))
    return {"all": F.lit(1.0), "important": importance, "frequent": often, "emotional": feeling, "combined": importance * 0.4 + activation * 0.3 + often * 0.2 + feeling * 0.1}[strategy]


def should_consolidate(importance: Column, activation: Column, accesses: Column, least_importance: float = 0.3, least_activation: float = 0.2, least_accesses: int = 1) -> Column:
    return (importance >= least_importance) | (activation >= least_activation) | (accesses >= least_accesses)


def confidence_boost(confidence: Column) -> Column:
    """(confidence - 0.5) * 0.1; null counts as 1."""
    return (F.coalesce(confidence, F.lit(1.0)) - 0.5) * 0.1


def similarity_class(score: Column, similar: float = 0.8, merge: float = 0.9, duplicate: float = 0.95) -> Column:
    return F.when(score >= duplicate, "duplicate").when(score >= merge, "merge").when(score >= similar, "similar").otherwise("different")


def displaced_by(items: DataFrame, policy: str, keep: int, by: list[str], key: str, at: str, used: str, priority: str, activation: str, now: Column) -> DataFrame:
    """Items beyond ``keep`` a set, by oldest, priority, least_recent or combined (0.4 of the priority, 0.3 of the activation,
    0.3 / (1 + idle seconds)): the lowest go first, ties to the smaller key."""
    idle = F.unix_micros(now) / 1e6 - F.unix_micros(F.col(used)) / 1e6
    score = {"oldest": F.col(at), "priority": F.col(priority), "least_recent": F.col(used), "combined": F.col(priority) * 0.4 + F.col(activation) * 0.3 + 0.3 / (1 + idle)}[policy]
    w = Window.partitionBy(*by)
    rows = items.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(score, key))})
    return rows.where(F.col("_r") <= F.col("_n") - keep).drop("_n", "_r")


def rehearsed(activation: Column, act: Column) -> Column:
    """Activation after focus (+0.3), rehearse (+0.3) or access (+0.2), 1 at most; other acts change nothing."""
    return F.least(F.lit(1.0), activation + F.when(act.isin("focus", "rehearse"), 0.3).when(act == "access", 0.2).otherwise(0.0))


def sleep_boosted(memories: DataFrame, order: str, key: str, boost: float = 0.3, newest: int = 100) -> DataFrame:
    """``strength`` raised by the boost, 1 at most, for the newest ones."""
    new = memories.orderBy(F.desc(order), key).limit(newest).select(F.col(key).alias("_k"))  # a bounded list
    rows = memories.join(F.broadcast(new), memories[key] == new["_k"], "left")
    return rows.withColumn("strength", F.when(F.col("_k").isNotNull(), F.least(F.lit(1.0), F.col("strength") + boost)).otherwise(F.col("strength"))).drop("_k")


def without_branch(rows: DataFrame, branch: str, force: bool = False) -> DataFrame:
    """Rows of all other branches; 'main' can't go, and one with unmerged rows only by force."""
    if branch == "main":
        raise ValueError("main stays")
    if not force and "merged" in rows.columns and not rows.where((F.col("branch") == branch) & ~F.col("merged")).isEmpty():
        raise ValueError(f"{branch} has rows that are not merged")
    return rows.where(F.col("branch") != branch)


def branches(rows: DataFrame) -> DataFrame:
    """(branch, rows, last_at)."""
    return rows.groupBy("branch").agg(F.count("*").alias("rows"), F.max("created_at").alias("last_at"))


def default_merge(a: Column, b: Column) -> Column:
    """Where one value holds the other, case aside, the longer; else both, joined by '; '."""
    return F.when(F.contains(F.lower(b), F.lower(a)), b).when(F.contains(F.lower(a), F.lower(b)), a).otherwise(F.concat_ws("; ", a, b))


def weighted_merge(facts: DataFrame, weights: DataFrame, default: float = 0.5) -> DataFrame:
    """One fact per (domain, lower key): the highest confidence * weight of its source (clamped to 0..1; ``default`` without
    one), then the first value in order. ``weights`` has (source, weight)."""
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(default))))
    rows = facts.join(weights, "source", "left").withColumn("confidence", F.col("confidence") * weight)
    best = rows.groupBy("domain", F.lower("key").alias("key")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "value", "source")).alias("b"))
    return best.select("domain", "key", "b.value", "b.source", (-F.col("b.c")).alias("confidence"))


def team_actions(known: DataFrame, incoming: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """(key, action): update where the incoming version is higher, insert where the key is new, else skip."""
    rows = incoming.select(key, F.col(version).alias("_in")).join(known.select(key, F.col(version).alias("_has")), key, "left")
    return rows.select(key, F.when(F.col("_has").isNull(), "insert").when(F.col("_in") > F.col("_has"), "update").otherwise("skip").alias("action"))


def registered(profiles: DataFrame, acts: DataFrame) -> DataFrame:
    """Source profiles (source, trust, verified) after acts (source, at, act): verify, block or trust, the last one deciding
    the trust; acts on unknown sources change nothing."""
    done = acts.where(F.col("act").isin("verify", "block", "trust")).groupBy("source").agg(F.max_by("act", "at").alias("act"), F.max((F.col("act") == "verify").cast("int")).alias("v"))
    trust = F.when(F.col("act") == "verify", "verified").when(F.col("act") == "block", "blocked").when(F.col("act") == "trust", "trusted").otherwise(F.col("trust"))
    return profiles.join(done, "source", "left").select("source", trust.alias("trust"), (F.col("verified") | (F.coalesce("v", F.lit(0)) == 1)).alias("verified"))


def suspicious(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("trust").isin("suspicious", "blocked"))


def validated(rows: DataFrame, checks: list[tuple[str, Column]], order: str | None = None) -> DataFrame:
    """Rows with ``rejected``: the name of the first check (in order) whose condition holds, else null. With ``order`` the
    batch fails fast: rows after the first rejected one are left out."""
    out = rows.withColumn("rejected", F.coalesce(*[F.when(test, name) for name, test in checks]))
    if order is None:
        return out
    first = out.where("rejected is not null").agg(F.min(order).alias("_first"))
    return out.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_first")


def projected(rows: DataFrame, names: dict[str, str], nested: dict[str, list[str]]) -> DataFrame:
    """Columns renamed, and others nested into structs by name."""
    return rows.select(*[F.col(a).alias(b) for a, b in names.items()], *[F.struct(*cs).alias(n) for n, cs in nested.items()])


def cluster_health(nodes: DataFrame, now: Column, timeout: float = 15.0) -> DataFrame:
    """(state, nodes, shards) of (node, state, last_heartbeat, shards): a node not heard of for over ``timeout`` seconds has
    failed."""
    late = F.unix_micros(now) / 1e6 - F.unix_micros("last_heartbeat") / 1e6 > timeout
    return nodes.groupBy(F.when(late, "failed").otherwise(F.col("state")).alias("state")).agg(F.count("*").alias("nodes"), F.sum("shards").alias("shards"))


def replica_lags(replicas: DataFrame, primaries: DataFrame) -> DataFrame:
    """(shard, node, lag, promoted): messages behind the primary; the replica of the least lag, then the first by name, would
    take over."""
    lag = replicas.join(primaries.select("shard", F.col("position").alias("_p")), "shard").withColumn("lag", F.col("_p") - F.col("position"))
    best = lag.groupBy("shard").agg(F.min(F.struct("lag", "node")).alias("b")).select("shard", F.col("b.node").alias("_n"))
    return lag.join(best, "shard").select("shard", "node", "lag", (F.col("node") == F.col("_n")).alias("promoted"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
