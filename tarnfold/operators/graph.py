"""Property-graph operators over edges (src, dst, type, weight, confidence) and vertices (id, type, ...).

Traversals are level-by-level joins of a frontier with the edges; the number of levels is a parameter, and each level
keeps one row a reached vertex and is cut, so plans stay bounded and no visited set leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.graph_query import split_hubs, stepped
from tarnfold.session import cut


#: Rows of a part whose ends a task tells apart.
ROWS = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; a self-loop twice."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def k_hop(edges: DataFrame, starts: DataFrame, depth: int, undirected: bool = False, types: list[str] | None = None, min_weight: float | None = None) -> DataFrame:
    """(start, node, depth): the least depth from 1 to ``depth``; a start itself is not its own neighbour."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    if min_weight is not None:
        edges = edges.where(F.col("weight") >= min_weight)
    step, hubs = split_hubs(cut((both_ways(edges) if undirected else edges).select("src", "dst").distinct()))
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for level in range(1, depth + 1):
        found = stepped(frontier, step, hubs).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int, undirected: bool = True) -> DataFrame:
    """(start, node, path): a shortest path to each vertex within reach, the first in order among equally short ones."""
    step, hubs = split_hubs(cut((both_ways(edges) if undirected else edges).select("src", "dst").distinct()))
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    seen = frontier
    for _ in range(max_depth):
        found = stepped(frontier, step, hubs).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = found.groupBy("start", "node").agg(F.min("path").alias("path"))
        frontier = cut(best.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def triples(vertices: DataFrame, edges: DataFrame, subject: Column | None = None, predicate: str | None = None, obj: Column | None = None) -> DataFrame:
    """(s, predicate, o): vertices by edges by vertices; ``subject`` and ``obj`` filter vertex columns."""
    s = (vertices if subject is None else vertices.where(subject)).select(F.col("id").alias("s"))
    o = (vertices if obj is None else vertices.where(obj)).select(F.col("id").alias("o"))
    e = edges if predicate is None else edges.where(F.col("type") == predicate)
    return e.join(s, e["src"] == F.col("s")).join(o, F.col("dst") == F.col("o")).select("s", F.col("type").alias("predicate"), "o")


def path_pattern(edges: DataFrame, steps: list[tuple[str | None, str]], start: DataFrame | None = None) -> DataFrame:
    """All walks along (type, direction) steps as columns n0, n1, ...; vertices may repeat."""
    out = None
    for i, (kind, direction) in enumerate(steps):
        e = edges if kind is None else edges.where(F.col("type") == kind)
        e = e if direction == "out" else both_ways(e) if direction == "both" else e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        e = e.select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"))
        if out is None:
            out = e if start is None else e.join(start.select(F.col("id").alias("n0")), "n0", "left_semi")
        else:
            out = out.join(e, f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(steps) + 1)])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours, out and in. Ends are told apart in parts of some ROWS, however many edges there are."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    parts = max(1, -(-2 * edges.count() // ROWS))
    return edges.select(ends).select("e.src", "e.dst").repartition(parts, "src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def infer_transitive(edges: DataFrame, first: str, second: str, becomes: str, factor: float = 1.0, least: float = 0.5) -> DataFrame:
    """a -first-> b -second-> c gives a -becomes-> c, confidences multiplied with the factor of each hop, once a pair."""
    a = edges.where(F.col("type") == first).select("src", F.col("dst").alias("mid"), F.col("confidence").alias("c1"))
    b = edges.where(F.col("type") == second).select(F.col("src").alias("mid"), "dst", F.col("confidence").alias("c2"))
    c = F.col("c1") * factor * F.col("c2") * factor
    got = a.join(b, "mid").where("src <> dst").groupBy("src", "dst").agg(F.max(c).alias("confidence"))
    return got.where(F.col("confidence") >= least).select("src", "dst", F.lit(becomes).alias("type"), "confidence")


def infer_symmetric(edges: DataFrame, kind: str, factor: float = 0.95) -> DataFrame:
    """Reverse edges that are missing."""
    e = edges.where(F.col("type") == kind)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", (F.col("confidence") * factor).alias("confidence"))
    return back.join(e.select("src", "dst"), ["src", "dst"], "left_anti")


def causal_chains(edges: DataFrame, kinds: list[str], start: DataFrame, max_steps: int = 5, least: float = 0.5) -> DataFrame:
    """(path, confidence): maximal chains from the starts whose confidence stays at or above the least."""
    e = edges.where(F.col("type").isin(kinds)).select("src", "dst", F.col("confidence").alias("c"))
    now = start.select(F.array("id").alias("path"), F.lit(1.0).alias("confidence"))
    done = []
    for step in range(max_steps):
        end = F.element_at("path", -1)
        on = now.join(e, end == e["src"]).where(F.col("confidence") * F.col("c") >= least)
        grown = on.select(F.concat("path", F.array("dst")).alias("path"), (F.col("confidence") * F.col("c")).alias("confidence"))
        stopped = now.join(on.select("path").distinct(), "path", "left_anti")
        done.append(stopped.where(F.size("path") > 1))
        now = grown
    done.append(now)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def analogies(structure: DataFrame, source, k: int = 10, least: float = 0.0) -> DataFrame:
    """(id, similarity): Jaccard of (id, feature) sets with the source's, by joining on the source's features alone."""
    pairs = structure.select("id", "feature").distinct()
    own = pairs.where(F.col("id") == source).select("feature")
    n = own.agg(F.count("*").alias("n"))
    size = pairs.groupBy("id").agg(F.count("*").alias("m"))
    shared = pairs.join(own, "feature", "left_semi").where(F.col("id") != source).groupBy("id").agg(F.count("*").alias("both"))
    s = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    return shared.join(size, "id").crossJoin(F.broadcast(n)).select("id", s.alias("similarity")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


def contradictions(edges: DataFrame, opposites: list[tuple[str, str]]) -> DataFrame:
    """(src, dst, a, b): edges of opposite types between the same vertices."""
    kinds = edges.select("src", "dst", "type").distinct().groupBy("src", "dst").agg(F.collect_set("type").alias("kinds"))
    hit = F.array_compact(F.array(*[F.when(F.array_contains("kinds", a) & F.array_contains("kinds", b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in opposites]))
    return kinds.select("src", "dst", F.explode(hit).alias("h")).select("src", "dst", "h.*")


def suggest(edges: DataFrame, source: DataFrame, via: list[str], least: float = 0.5) -> DataFrame:
    """(src, dst, type, confidence): edges of the source's neighbours (over ``via``) that it lacks, at 0.8 of theirs."""
    near = edges.where(F.col("type").isin(via)).join(source.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("s"), F.col("dst").alias("n")).distinct()
    got = near.join(edges, near["n"] == edges["src"]).where("dst <> s").select(F.col("s").alias("src"), "dst", "type", (F.col("confidence") * 0.8).alias("confidence"))
    got = got.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= least)
    return got.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")


def decayed(edges: DataFrame, rate: float = 0.01, least: float = 0.1) -> DataFrame:
    return edges.withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") - rate)).where(F.col("weight") >= least)


def merge_entities(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with (old -> new) ids rewired: self-loops go, repeated edges keep the highest weight and confidence."""
    s = edges.join(remap.select(F.col("old").alias("src"), F.col("new").alias("_s")), "src", "left")
    o = s.join(remap.select(F.col("old").alias("dst"), F.col("new").alias("_d")), "dst", "left")
    return o.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "type", "weight", "confidence").where("src <> dst").groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"))


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """(name, type, mentions, aliases) of (name, type) mentions, by lower-cased stripped name."""
    return mentions.groupBy(F.trim(F.lower(F.col("name"))).alias("key"), "type").agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("name")).alias("aliases"))


def top_degrees(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def augmented(scored: DataFrame, hits: DataFrame, key: str, boost: float = 0.3, k: int = 10) -> DataFrame:
    """Search scores plus boost * (graph score / largest graph score), best k."""
    most = hits.join(scored.select(key), key, "left_semi").agg(F.max("graph").alias("_m"))  # one row
    both = scored.join(hits.select(key, "graph"), key, "left").crossJoin(F.broadcast(most))
    share = F.when(F.col("_m") > 0, F.col("graph") / F.col("_m"))
    return both.select(key, (F.col("score") + F.coalesce(boost * share, F.lit(0.0))).alias("score")).orderBy(F.desc("score"), key).limit(k)
