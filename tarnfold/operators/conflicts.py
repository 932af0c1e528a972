"""Conflicts between similar texts, their severity and resolution, and consolidation runs with their reports."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions import rules as rl
from tarnfold.functions import text as tx
from tarnfold.operators import consolidation as co
from tarnfold.session import cut

# Fixed values: "key states value" patterns, and words that are no context.
VALUES = (r"(\w+(?:\s+\w+)?)\s+(?:is|are|was|were|=|:)\s+(.+)", r"(?:the\s+)?(\w+(?:\s+\w+)?)\s+(?:equals?|is\s+set\s+to)\s+(.+)")
NO_CONTEXT = ("the", "a", "an", "is", "are", "was", "were", "in", "on", "at")


def _stated(a: Column, b: Column) -> Column:
    """struct(key, va, vb) where both texts state a value for one key and the values differ, by the first pattern that
    shows it; else null."""
    found = []
    for p in VALUES:
        part = lambda t, g, p=p: F.regexp_extract(t, "(?i)" + p, g)
        va, vb = F.trim(part(a, 2)), F.trim(part(b, 2))
        hit = (part(a, 1) != "") & (F.lower(part(a, 1)) == F.lower(part(b, 1))) & (F.lower(va) != F.lower(vb))
        found.append(F.when(hit, F.struct(F.lower(part(a, 1)).alias("key"), va.alias("va"), vb.alias("vb"))))
    return F.coalesce(*found)


def dates(text: Column) -> Column:
    """Distinct date strings."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in rl.DATES]))))


def same_context(a: Column, b: Column) -> Column:
    """Without dates and NO_CONTEXT words, over half of the shorter text's distinct words are the other's too."""

    def left(t: Column) -> Column:
        for p in rl.DATES:
            t = F.regexp_replace(t, p, "")
        return F.array_except(tx.word_set(t), F.array(*[F.lit(w) for w in NO_CONTEXT]))

    x, y = left(a), left(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)) > 0.5)


def severity(a_conf: Column, b_conf: Column, alike: Column) -> Column:
    """Of a value conflict: both sure, critical; one sure and one unsure, medium; like values, low; else high."""
    return F.when((a_conf > 0.8) & (b_conf > 0.8), "critical").when(((a_conf > 0.8) | (b_conf > 0.8)) & ((a_conf < 0.5) | (b_conf < 0.5)), "medium").when(alike, "low").otherwise("high")


def _with_alike(rows: DataFrame) -> DataFrame:
    """``alike``: one of the values va, vb holds the other, or difflib's ratio is over 0.8. Few rows have values at all."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda v: re.sub(r"\s+", " ", v.lower().strip())
        for pdf in batches:
            pairs = [None if a is None else (plain(a), plain(b)) for a, b in zip(pdf["va"], pdf["vb"])]
            pdf["alike"] = [p is not None and (p[0] in p[1] or p[1] in p[0] or difflib.SequenceMatcher(None, *p).ratio() > 0.8) for p in pairs]
            yield pdf

    return rows.mapInPandas(work, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", alike boolean")


def conflicts(pairs: DataFrame, gap: float = 0.5, least: float = 0.7) -> DataFrame:
    """(a_id, b_id, kind, severity) of pairs (a_id, b_id, a, b, similarity, a_conf, b_conf, a_source, b_source, a_trust,
    b_trust) of at least the similarity: value, temporal, confidence_gap, contradiction and source conflicts, a row each.
    Null confidence and trust count as 1, null sources say nothing, null texts state nothing."""
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    ac, bc, at, bt = (F.coalesce(c, F.lit(1.0)) for c in ("a_conf", "b_conf", "a_trust", "b_trust"))
    sim = F.col("similarity")
    other = F.coalesce((F.col("a_source") != "") & (F.col("b_source") != "") & (F.col("a_source") != F.col("b_source")), F.lit(False))
    da, db = dates(a), dates(b)
    rows = pairs.where(sim >= least).select(
        "a_id", "b_id", ac.alias("ac"), bc.alias("bc"), _stated(a, b).alias("v"),
        ((F.size(da) > 0) & (F.size(db) > 0) & (da != db) & same_context(a, b)).alias("temporal"),
        ((F.abs(ac - bc) >= gap) & (sim > 0.9)).alias("unsure"),
        co.contradicts(a, b).alias("denied"),
        (other & (sim > 0.95) & (F.abs(at - bt) > 0.3)).alias("sources"),
    )
    rows = _with_alike(rows.select("a_id", "b_id", "ac", "bc", "v.va", "v.vb", "temporal", "unsure", "denied", "sources"))
    one = lambda test, kind, how: F.when(test, F.struct(F.lit(kind).alias("kind"), (how if isinstance(how, Column) else F.lit(how)).alias("severity")))
    found = F.array_compact(
        F.array(
            one(F.col("va").isNotNull(), "value_conflict", severity(F.col("ac"), F.col("bc"), F.col("alike"))),
            one(F.col("temporal"), "temporal_conflict", "medium"),
            one(F.col("unsure"), "confidence_gap", "low"),
            one(F.col("denied"), "semantic_contradiction", "medium"),
            one(F.col("sources"), "source_conflict", "low"),
        )
    )
    return rows.select("a_id", "b_id", F.explode(found).alias("c")).select("a_id", "b_id", "c.*").dropDuplicates(["a_id", "b_id", "kind"])


def conflict_summary(found: DataFrame) -> DataFrame:
    """(kind, severity, n)."""
    return found.groupBy("kind", "severity").agg(F.count("*").alias("n"))


def winner(a_id: Column, b_id: Column, strategy: str, a_conf: Column, b_conf: Column, a_at: Column, b_at: Column) -> Column:
    """confidence_wins or latest_wins, the first among equals; merge leaves it open."""
    if strategy == "confidence_wins":
        return F.when(F.coalesce(a_conf, F.lit(1.0)) >= F.coalesce(b_conf, F.lit(1.0)), a_id).otherwise(b_id)
    if strategy == "latest_wins":
        return F.when(F.coalesce(a_at >= b_at, b_at.isNull()), a_id).otherwise(b_id)
    return F.lit(None)


def consolidate(memories: DataFrame, key: str = "id", content: str = "content", confidence: str = "confidence", duplicate: float = 0.95, similar: float = 0.8, related: float = 0.7) -> dict[str, DataFrame]:
    """One run: ``duplicates`` (key, kept) of equal contents and of pairs from ``duplicate`` on; ``conflicts`` between
    contents from ``related`` on, each content by its least key; ``clusters`` (id, cluster) of what is kept, from ``similar``
    on; ``merged`` clusters. Nothing is written; a dry run takes the first three."""
    rows = memories.select(F.col(key).alias("id"), F.col(content).alias("content"), F.col(confidence).alias("confidence"))
    texts = cut(rows.groupBy(tx.content_hash(F.col("content")).alias("h")).agg(F.min(F.struct("id", "content", "confidence")).alias("r")).select("h", "r.*"))
    pairs = cut(co.near_pairs(texts, related, "id", "content"))
    joined = co.clusters(pairs.where(F.col("similarity") >= duplicate)).select("id", F.col("cluster").alias("kept"))
    of_text = cut(texts.join(joined, "id", "left").select("h", "id", "content", "confidence", F.coalesce("kept", "id").alias("kept")))
    duplicates = rows.select("id", tx.content_hash(F.col("content")).alias("h")).join(of_text.select("h", "kept"), "h").select("id", "kept")
    side = lambda s: texts.select(F.col("id").alias(s), F.col("content").alias(f"{s}_t"), F.col("confidence").alias(f"{s}_conf"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    nothing = F.lit(None)
    found = conflicts(
        both.select(
            F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.col("a_t").alias("a"), F.col("b_t").alias("b"), "similarity", "a_conf", "b_conf",
            nothing.cast("string").alias("a_source"), nothing.cast("string").alias("b_source"), nothing.cast("double").alias("a_trust"), nothing.cast("double").alias("b_trust"),
        ),
        least=related,
    )
    kept = of_text.where("id = kept")
    near = pairs.where(F.col("similarity") >= similar).join(kept.select(F.col("id").alias("a")), "a", "left_semi").join(kept.select(F.col("id").alias("b")), "b", "left_semi")
    clusters = cut(co.clusters(near))
    merged = co.merged(kept.join(clusters, "id"), "cluster", "keep_best", "id")
    return {"duplicates": duplicates, "conflicts": found, "clusters": clusters, "merged": merged}


def report(memories: DataFrame, run: dict[str, DataFrame]) -> DataFrame:
    """One row: counts of a run, and what to do."""
    counts = memories.agg(F.count("*").alias("memories")).crossJoin(run["duplicates"].agg(F.count_if(F.col("id") != F.col("kept")).alias("duplicates")))
    counts = counts.crossJoin(run["conflicts"].agg(F.count("*").alias("conflicts"))).crossJoin(run["clusters"].agg(F.countDistinct("cluster").alias("clusters")))
    return counts.withColumn("advice", advice(F.col("duplicates"), F.col("conflicts"), F.col("clusters")))


def advice(duplicates: Column, found: Column, clusters: Column) -> Column:
    """Texts of a report, joined by '|'."""
    said = F.concat_ws(
        "|",
        F.when(duplicates > 0, F.format_string("Found %d potential duplicates. Run consolidation to remove them.", duplicates)),
        F.when(found > 0, F.format_string("Detected %d conflicts. Review and resolve to maintain data consistency.", found)),
        F.when(clusters > 0, F.format_string("Found %d similarity clusters. Consider merging related memories.", clusters)),
    )
    return F.when(said == "", "Memory store is well-organized. No action needed.").otherwise(said)


def batch_duplicates(memories: DataFrame, position: str, size: int = 100, content: str = "content") -> DataFrame:
    """(batch, memories, duplicates): independent batches of ``size`` positions, equal contents counted inside each."""
    rows = memories.select(F.floor(F.col(position) / size).alias("batch"), tx.content_hash(F.col(content)).alias("h"))
    per = rows.groupBy("batch", "h").agg(F.count("*").alias("n"))
    return per.groupBy("batch").agg(F.sum("n").alias("memories"), (F.sum("n") - F.count("*")).alias("duplicates"))


def estimate(memories: DataFrame, key: str = "id", content: str = "content", sample: int = 100, threshold: float = 0.95, seed: int = 7) -> DataFrame:
    """One row (memories, exact, groups, sampled, fuzzy, total, percent): equal contents counted over all rows; pairs of at
    least the word similarity counted in a sample, the ``sample`` keys of the least hash (none of under 10), and carried
    over to all pairs."""
    counts = memories.groupBy(tx.content_hash(F.col(content)).alias("h")).agg(F.count("*").alias("n"))
    exact = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("memories"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact"), F.count_if(F.col("n") > 1).alias("groups"))
    few = cut(memories.select(F.col(key).alias("id"), F.col(content).alias("content")).orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample))
    words = few.select("id", tx.word_set(F.col("content")).alias("w"))
    a, b = words.select(F.col("id").alias("a"), F.col("w").alias("wa")), words.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    # at most ``sample`` rows a side
    hits = a.join(F.broadcast(b), F.col("a") < F.col("b")).where(tx.jaccard(F.col("wa"), F.col("wb")) >= threshold - 1e-12).agg(F.count("*").alias("hits"))
    both = exact.crossJoin(F.broadcast(words.agg(F.count("*").alias("sampled")))).crossJoin(F.broadcast(hits))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    fuzzy = F.when(F.col("sampled") < 10, F.lit(0)).otherwise(F.floor(F.col("hits") / pairs("sampled") * pairs("memories")))
    both = both.withColumn("fuzzy", fuzzy.cast("long")).withColumn("total", F.col("exact") + F.col("fuzzy"))
    return both.select("memories", "exact", "groups", "sampled", "fuzzy", "total", (F.col("total") / F.greatest("memories", F.lit(1)) * 100).alias("percent"))
