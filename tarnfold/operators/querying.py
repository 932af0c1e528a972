"""Query analysis, expansion and the small query language; hash ring; token budgets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.functions import rules as rl

# Words that are no keywords.
STOPWORDS = """a an the is are was were be been being have has had do does did will would could should may might must shall can to of in for on with at by from as into through
during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very
just and but or because if until while about against out up down off over this that these those what which who whom it its i me my we you your he she they them""".split()

# Synonyms by word.
SYNONYMS = {
    "create": ["make", "build", "generate", "produce"], "delete": ["remove", "erase", "destroy", "eliminate"], "update": ["modify", "change", "edit", "revise"],
    "find": ["search", "locate", "discover", "retrieve"], "help": ["assist", "support", "aid", "guide"], "error": ["bug", "issue", "problem", "failure"],
    "fast": ["quick", "rapid", "speedy", "efficient"], "important": ["critical", "crucial", "significant", "key"], "user": ["person", "individual", "customer", "client"],
    "data": ["information", "content", "records", "details"],
}

# Lines that carry one of these are kept by compression.
CRITICAL = r"\[CRITICAL\]|\[IMPORTANT\]|\[REMEMBER\]|\[KEY\]|\[NOTE\]|\[PRESERVE\]|(?:^|\s)IMPORTANT:|(?:^|\s)NOTE:|(?:^|\s)CRITICAL:|must remember|don't forget|key point|important:"


def keywords(text: Column) -> Column:
    """Words of more than two letters that are no stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 2))


def expanded(text: Column, most: int = 3) -> Column:
    """Up to ``most`` variants with a synonym in place of a word (wherever its letters stand), in word order."""
    low = F.lower(text)
    table = F.create_map(*[c for w, s in SYNONYMS.items() for c in (F.lit(w), F.array(*[F.lit(x) for x in s[:most]]))])
    words = F.filter(F.regexp_extract_all(low, F.lit(r"\S+"), F.lit(0)), lambda w: F.map_contains_key(table, w))
    variants = F.flatten(F.transform(words, lambda w: F.transform(table[w], lambda s: F.replace(low, w, s))))
    return F.slice(F.filter(F.array_distinct(variants), lambda v: v != low), 1, most)


def sanitized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def critical_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("(?i)" + CRITICAL))


def chunked(text: Column, size: int, overlap: int = 0) -> Column:
    """Runs of ``size`` words, each starting size - overlap after the last; the last one ends the text."""
    step = size - overlap

    def cut_up(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - overlap) / step).cast("int") - 1))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")))

    # bound by a lambda, so that the words are found once a text, not once a chunk
    return F.when(text.isNotNull(), F.transform(F.array(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))), cut_up)[0])


def truncated(text: Column, most: int, marker: str = "...") -> Column:
    w = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit(marker))).otherwise(text)


def ring(spark: SparkSession, nodes: list[str], points: int = 150) -> DataFrame:
    """(low, high, node): arcs of a consistent-hash ring by the first 15 hex digits of md5; a key goes to the node of the
    first point above its hash, the last arc wraps to the first point."""
    at = sorted((int(hashlib.md5(f"{n}:{i}".encode()).hexdigest()[:15], 16), n) for n in nodes for i in range(points))
    ends = [(0 if i == 0 else at[i - 1][0], p, n) for i, (p, n) in enumerate(at)] + [(at[-1][0], 1 << 60, at[0][1])]
    return spark.createDataFrame(ends, "low long, high long, node string")


def ring_node(keys: DataFrame, key: str, arcs: DataFrame) -> DataFrame:
    """(key, node). Arcs are few (nodes times points): the range join broadcasts them, bucketed by the hash's top bits so
    that a key meets only the arcs of its bucket."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long")
    bucketed = arcs.withColumn("bucket", F.explode(F.sequence(F.shiftright("low", 52), F.shiftright(F.col("high") - 1, 52))))
    rows = keys.select(key, h.alias("h")).withColumn("bucket", F.shiftright("h", 52))
    return rows.join(F.broadcast(bucketed), "bucket").where("h >= low AND h < high").select(key, "node")


def push_changes(local: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose version is above the remote manifest's, or that it lacks."""
    known = manifest.select(key, F.col("version").alias("_remote"))
    return local.join(known, key, "left").where(F.col("_remote").isNull() | (F.col("version") > F.col("_remote"))).drop("_remote")


def boosted_by_sources(facts: DataFrame, by: list[str]) -> DataFrame:
    """Confidence + 0.1 for each further source that says the same, at most 1."""
    got = facts.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.countDistinct("source").alias("sources"))
    return got.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + 0.1 * (F.col("sources") - 1)))


def consolidation_groups(rows: DataFrame, group: str, score: str, key: str, most: int = 10) -> DataFrame:
    """The best ``most`` rows of each group."""
    order = Window.partitionBy(group).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def query_kind(text: Column) -> Column:
    """navigational, conceptual or factual by how it starts; more than 20 words: similarity; else exploratory."""
    q = F.trim(F.lower(text))
    out = None
    for kind, starts in rl.QUERY_STARTS:
        test = F.lit(False)
        for s in starts:
            test = test | q.startswith(s)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.when(F.regexp_count(q, F.lit(r"\S+")) > 20, "similarity").otherwise("exploratory")


def semantic_weight(text: Column) -> Column:
    """The kind's weight, 0.2 less (0.3 at least) where keywords have more than 8 letters on average."""
    kind, words = query_kind(text), keywords(text)
    base = F.lit(0.7)
    for k, w in rl.QUERY_WEIGHTS.items():
        base = F.when(kind == k, w).otherwise(base)
    mean = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / F.greatest(F.size(words), F.lit(1))
    return F.when(mean > 8, F.greatest(F.lit(0.3), base - 0.2)).otherwise(base)


def events_since(log: DataFrame, clock: Column, seen: dict[str, int], limit: int = 100, order: str = "event_id") -> DataFrame:
    """Events whose map clock is not at or before ``seen``: later or concurrent ones, the oldest first."""
    known = F.create_map(*[F.lit(x) for kv in seen.items() for x in kv]) if seen else F.create_map().cast("map<string,bigint>")
    new = F.exists(F.map_entries(clock), lambda e: e["value"] > F.coalesce(F.try_element_at(known, e["key"]), F.lit(0)))
    return log.where(new).orderBy(order).limit(limit)
