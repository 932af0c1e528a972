"""Version logs, snapshots, branch merges, conflict policies, access rules and vector clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """The row of the highest version of each key: one aggregate, no sort."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(*key, "_r.*")


def as_of_version(log: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``log`` at the (key, version) pairs asked for."""
    return log.join(wanted.select(key, "version"), [key, "version"])


def snapshot(live: DataFrame, key: str = "id") -> DataFrame:
    """(key, version) of live rows: what a commit stores."""
    return live.where("not is_deleted").select(key, "version")


def rollback(current: DataFrame, committed: DataFrame, key: str = "id") -> DataFrame:
    """(key, action, version): restore what differs from the commit, tombstone what is not in it, keep the rest."""
    c, s = current.select(F.col(key), F.col("version").alias("_now")), committed.select(F.col(key), F.col("version").alias("_then"))
    action = F.when(F.col("_then").isNull(), "tombstone").when(F.col("_now").isNull() | (F.col("_now") != F.col("_then")), "restore").otherwise("keep")
    return c.join(s, key, "full_outer").select(key, action.alias("action"), F.coalesce("_then", "_now").alias("version"))


def merge_branches(ours: DataFrame, theirs: DataFrame, policy: str, key: str = "id") -> DataFrame:
    """(key, content, confidence, tags, version, updated_at, from_) of both branches' (same columns) union by key.

    A conflict is a key on both sides with different versions. latest: later updated_at, ours if equal; ours; theirs;
    merge: where contents agree, tags united and the higher confidence, else latest.
    """
    cols = ["content", "confidence", "tags", "version", "updated_at"]
    pack = lambda df, n: df.select(F.col(key), F.struct(*cols).alias(n))
    a, b = F.col("a"), F.col("b")
    newer = F.coalesce(b["updated_at"] > a["updated_at"], F.lit(False))
    conflict = a.isNotNull() & b.isNotNull() & (a["version"] != b["version"])
    take_b = a.isNull() | (conflict & {"latest": newer, "ours": F.lit(False), "theirs": F.lit(True), "merge": newer}[policy])
    joined = pack(ours, "a").join(pack(theirs, "b"), key, "full_outer")
    pick = F.when(take_b, b).otherwise(a)
    out = joined.select(key, pick.alias("p"), F.when(take_b, "theirs").otherwise("ours").alias("from_"), (conflict & (a["content"] == b["content"]) if policy == "merge" else F.lit(False)).alias("_m"), "a", "b")
    m = F.coalesce(F.col("_m"), F.lit(False))
    return out.select(
        key, F.col("p.content").alias("content"),
        F.when(m, F.greatest(a["confidence"], b["confidence"])).otherwise(F.col("p.confidence")).alias("confidence"),
        F.when(m, F.array_sort(F.array_union(a["tags"], b["tags"]))).otherwise(F.array_sort("p.tags")).alias("tags"),
        F.col("p.version").alias("version"), F.col("p.updated_at").alias("updated_at"), F.when(m, "merged").otherwise(F.col("from_")).alias("from_"),
    )


def upsert(base: DataFrame, incoming: DataFrame, key: str, policy: str = "replace") -> DataFrame:
    """replace: incoming rows win; skip: known keys stay; newer: the higher version wins."""
    if policy == "skip":
        return base.unionByName(incoming.join(base.select(key), key, "left_anti"))
    if policy == "replace":
        return base.join(incoming.select(key), key, "left_anti").unionByName(incoming)
    return latest(base.withColumn("_o", F.lit(1)).unionByName(incoming.withColumn("_o", F.lit(0))).withColumn("_v", F.struct("version", "_o")), [key], "_v").drop("_v", "_o")


def resolve(a: Column, b: Column, policy: str) -> Column:
    """Of two states (structs with version, created_at, updated_at): lww, fww or version; the first if equal."""
    take_b = {"lww": b["updated_at"] > a["updated_at"], "fww": b["created_at"] < a["created_at"], "version": b["version"] > a["version"]}[policy]
    return F.when(F.coalesce(take_b, F.lit(False)), b).otherwise(a)


def effective_permission(agents: DataFrame, rules: DataFrame) -> DataFrame:
    """(agent, namespace, permission) of agents' rows by their most specific rule: the agent's own before '*', then the
    namespace's own before '*'; none without one. Four equi-joins by kind of rule, as a '*' matches no key."""
    keys = agents.select("agent", "namespace").distinct()
    parts = []
    for rank, (own_agent, own_namespace) in enumerate(((True, True), (True, False), (False, True), (False, False))):
        side = rules.where(((F.col("r_agent") != "*") == F.lit(own_agent)) & ((F.col("r_namespace") != "*") == F.lit(own_namespace)))
        side = side.groupBy("r_agent", "r_namespace").agg(F.min("permission").alias("permission"))
        on = [keys["agent"] == side["r_agent"]] * own_agent + [keys["namespace"] == side["r_namespace"]] * own_namespace
        met = keys.join(side, on) if on else keys.crossJoin(F.broadcast(side))  # the rule for all: one row
        parts.append(met.select("agent", "namespace", F.lit(rank).alias("rank"), "permission"))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    best = found.groupBy("agent", "namespace").agg(F.min_by("permission", "rank").alias("permission"))
    return keys.join(best, ["agent", "namespace"], "left").select("agent", "namespace", F.coalesce("permission", F.lit("none")).alias("permission"))


def merge_clocks(a: Column, b: Column) -> Column:
    """Pointwise maximum of two map<string, bigint>."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_order(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent, by pointwise comparison with 0 for missing nodes."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.signum((F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("double"))))
    less, more = F.exists(both, lambda s: s < 0), F.exists(both, lambda s: s > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def acl_rank(permission: Column) -> Column:
    return F.when(permission == "admin", 3).when(permission == "write", 2).when(permission == "read", 1).otherwise(0)


def history(log: DataFrame, key: str, value, limit: int) -> DataFrame:
    return log.where(F.col(key) == value).orderBy(F.desc("version")).limit(limit)


def numbered(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Version numbers from 1 in the given order."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
