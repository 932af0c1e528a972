"""Kinds of relations, a driver over inference rules, explanations of a relation, and entity search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.operators import graph as gr
from tarnfold.session import cut

# Inverse types, categories of types (others are associative), words of relation patterns, inference rules.
INVERSES = {
    "CAUSES": "CAUSED_BY", "CAUSED_BY": "CAUSES", "BEFORE": "AFTER", "AFTER": "BEFORE", "PART_OF": "HAS_PART", "HAS_PART": "PART_OF", "CONTAINS": "LOCATED_IN", "LOCATED_IN": "CONTAINS",
    "PARENT_OF": "CHILD_OF", "CHILD_OF": "PARENT_OF", "FOLLOWS": "PRECEDES", "PRECEDES": "FOLLOWS",
}
CATEGORIES = {
    "semantic": ("IS_A", "INSTANCE_OF", "SIMILAR_TO", "OPPOSITE_OF", "SYNONYM_OF", "DEFINED_AS"),
    "temporal": ("BEFORE", "AFTER", "DURING", "STARTS_WITH", "ENDS_WITH", "OVERLAPS"),
    "causal": ("CAUSES", "CAUSED_BY", "ENABLES", "PREVENTS", "REQUIRES", "LEADS_TO"),
    "spatial": ("LOCATED_IN", "CONTAINS", "NEAR", "ADJACENT_TO"),
    "associative": ("RELATED_TO", "MENTIONED_WITH", "ASSOCIATED_WITH", "REFERS_TO"),
    "hierarchical": ("PART_OF", "HAS_PART", "BELONGS_TO", "PARENT_OF", "CHILD_OF"),
    "procedural": ("FOLLOWS", "PRECEDES", "STEP_OF", "DEPENDS_ON"),
    "social": ("KNOWS", "WORKS_WITH", "CREATED_BY", "OWNED_BY"),
}
KEYWORDS = {
    "causation": ("because", "therefore", "thus", "causes", "leads to", "results in", "enables"),
    "temporal_sequence": ("before", "after", "then", "next", "subsequently", "previously", "followed by"),
    "hierarchy": ("is a", "type of", "part of", "belongs to", "includes", "contains"),
    "similarity": ("similar to", "like", "resembles", "comparable to", "related to"),
    "contradiction": ("contradicts", "opposes", "conflicts with", "unlike", "contrary to", "however", "but"),
}


@dataclass(frozen=True)
class Rule:
    """kind: transitive or causal (first, second -> becomes), or symmetric (first -> becomes)."""

    name: str
    kind: str
    first: str
    second: str | None
    becomes: str
    factor: float


RULES = (
    Rule("transitive_is_a", "transitive", "IS_A", "IS_A", "IS_A", 0.9),
    Rule("transitive_part_of", "transitive", "PART_OF", "PART_OF", "PART_OF", 0.85),
    Rule("transitive_causes", "causal", "CAUSES", "CAUSES", "LEADS_TO", 0.7),
    Rule("symmetric_similar", "symmetric", "SIMILAR_TO", None, "SIMILAR_TO", 0.95),
)


def inverse(kind: Column) -> Column:
    """The inverse type; null without one."""
    return F.create_map(*[F.lit(x) for kv in INVERSES.items() for x in kv])[kind]


def category(kind: Column) -> Column:
    out = F
    for name, kinds in CATEGORIES.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("associative")


def pattern_hits(text: Column) -> Column:
    """Names of the patterns of which a text holds any word, case aside, in order of their list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.array_compact(F.array(*[F.when(one(words), name) for name, words in KEYWORDS.items()]))


def infer(edges: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, kinds: list[str] | None = None) -> DataFrame:
    """(src, dst, type, rule, confidence) of all rules, of edges that are not there yet, two hops deep."""
    parts = []
    for r in rules:
        if kinds and r.kind not in kinds:
            continue
        if r.kind == "symmetric":
            got = gr.infer_symmetric(edges, r.first, r.factor).select("src", "dst", F.lit(r.becomes).alias("type"), "confidence").where(F.col("confidence") >= least)
        else:
            a = edges.where(F.col("type") == r.first).select("src", F.col("dst").alias("mid"), F.col("confidence").alias("c1"))
            b = edges.where(F.col("type") == r.second).select(F.col("src").alias("mid"), "dst", F.col("confidence").alias("c2"))
            got = a.join(b, "mid").where("src <> dst").groupBy("src", "dst").agg(F.max(F.col("c1") * F.col("c2") * r.factor).alias("confidence")).where(F.col("confidence") >= least)
            got = got.select("src", "dst", F.lit(r.becomes).alias("type"), "confidence")
        parts.append(got.withColumn("rule", F.lit(r.name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").select("src", "dst", "type", "rule", "confidence")


def explain(edges: DataFrame, asked: DataFrame, depth: int = 4) -> DataFrame:
    """(src, dst, hops, confidence, chain) of asked (src, dst): the direct edge of the highest confidence, or a shortest
    path (of equally short ones the surest, then the first in order of its text), confidences multiplied; pairs without
    one don't come back. A breadth-first frontier of the asked sources, one row a source and vertex."""
    step = edges.groupBy("src", "dst").agg(F.max(F.struct("confidence", "type")).alias("e")).select(F.col("src").alias("s"), F.col("dst").alias("t"), "e.*")
    step = cut(step)
    frontier = asked.select("src").distinct().select("src", F.col("src").alias("node"), F.lit(1.0).alias("c"), F.lit("").alias("chain"))
    seen = frontier.select("src", "node", F.lit(0).alias("hops"), "c", "chain")
    for hop in range(1, depth + 1):
        on = frontier.join(step, frontier["node"] == step["s"])
        text = F.concat(F.col("chain"), F.when(F.col("chain") == "", "").otherwise("; "), F.concat_ws(" ", "s", "type", "t"))
        found = on.select("src", F.col("t").alias("node"), (F.col("c") * F.col("confidence")).alias("c"), text.alias("chain"))
        best = found.groupBy("src", "node").agg(F.min(F.struct((-F.round("c", 12)).alias("r"), "chain", "c")).alias("b"))
        frontier = cut(best.select("src", "node", "b.c", "b.chain").join(seen.select("src", "node"), ["src", "node"], "left_anti"))
        seen = seen.unionByName(frontier.select("src", "node", F.lit(hop).alias("hops"), "c", "chain"))
    got = asked.join(seen.where("hops > 0").withColumnRenamed("node", "dst"), ["src", "dst"])
    return got.select("src", "dst", "hops", F.col("c").alias("confidence"), "chain")


def search_entities(entities: DataFrame, prefix: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Entities (name, type, mentions) with a word that starts with the prefix, case aside; most mentioned first, then by
    name."""
    rows = entities if kind is None else entities.where(F.col("type") == kind)
    hit = F.exists(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: F.startswith(w, F.lit(prefix.lower())))
    return list_entities(rows.where(hit), limit=limit)


def list_entities(entities: DataFrame, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = entities if kind is None else entities.where(F.col("type") == kind)
    return rows.orderBy(F.desc("mentions"), "name").offset(offset).limit(limit)
