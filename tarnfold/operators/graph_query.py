"""Graph queries with a score: start set, filters, traversal, sorting, paging and aggregates as one plan.

A traversal goes level by level: frontier by edges, the best edge a reached vertex, minus what its start has seen. Each level
is cut, so lineage stays as long as one level. Edges of hubs are dealt over several parts by their other end, and a frontier row at
a hub is repeated once a part, so no task has all edges of a vertex.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.session import cut

#: Edges of a vertex in one part, and rows up to which the table of hubs is broadcast.
PART_EDGES, BROADCAST_HUBS = 500_000, 100_000


def split_hubs(edges: DataFrame, part: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(edges with ``part``, hubs (src, parts)): a vertex of more than ``part`` edges has its edges dealt over parts by hash
    of dst. No hubs: None."""
    most = part or PART_EDGES
    hubs = cut(edges.groupBy("src").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1"))
    n = hubs.count()
    if not n:
        return edges.withColumn("part", F.lit(0)), None
    hubs = F.broadcast(hubs) if n <= BROADCAST_HUBS else hubs
    return edges.join(hubs, "src", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("parts"))).cast("int")).drop("parts"), hubs


def stepped(frontier: DataFrame, step: DataFrame, hubs: DataFrame | None, node: str = "node") -> DataFrame:
    """``frontier`` rows by the edges that leave their ``node``."""
    if hubs is None:
        return frontier.join(step.drop("part").withColumnRenamed("src", node), node)
    many = frontier.join(hubs.withColumnRenamed("src", node), node, "left")
    each = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return each.join(step.withColumnRenamed("src", node), [node, "part"]).drop("part")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as they are walked: out, in or both ways (a loop once)."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges if direction == "out" else back if direction == "in" else edges.unionByName(back.where("src <> dst"))


@dataclass(frozen=True)
class GraphQuery:
    """Over vertices (id, type, name, importance, ...) and edges (src, dst, type, weight, ...). Without a start set all
    vertices start. Without types and beyond depth 1, or with depth 0, the result is the start set itself."""

    ids: tuple = ()
    types: tuple[str, ...] = ()
    name: str | None = None
    fuzzy: bool = False
    wanted: tuple[Column, ...] = ()
    edges_wanted: tuple[Column, ...] = ()
    over: tuple[str, ...] = ()
    depth: int = 1
    direction: str = "out"
    key: str | None = None
    descending: bool = False
    most: int | None = None
    skip: int = 0
    once: bool = False
    paths: bool = False
    properties: tuple[tuple[str, str], ...] = ()

    def start(self, *ids) -> GraphQuery:
        return replace(self, ids=ids)

    def start_type(self, *types: str) -> GraphQuery:
        return replace(self, types=types)

    def start_name(self, name: str, fuzzy: bool = False) -> GraphQuery:
        """Names equal but for case, or with ``fuzzy`` those that contain it."""
        return replace(self, name=name, fuzzy=fuzzy)

    def where(self, *conditions: Column) -> GraphQuery:
        """Vertices that may be in the result, or on the way to it; starts too."""
        return replace(self, wanted=self.wanted + conditions)

    def where_edges(self, *conditions: Column) -> GraphQuery:
        return replace(self, edges_wanted=self.edges_wanted + conditions)

    def traverse(self, *types: str, depth: int = 1, direction: str = "out") -> GraphQuery:
        return replace(self, over=types, depth=depth, direction=direction)

    def sort(self, key: str, descending: bool = False) -> GraphQuery:
        return replace(self, key=key, descending=descending)

    def page(self, most: int | None, skip: int = 0) -> GraphQuery:
        return replace(self, most=most, skip=skip)

    def distinct(self) -> GraphQuery:
        return replace(self, once=True)

    def with_paths(self) -> GraphQuery:
        return replace(self, paths=True)

    @classmethod
    def parse(cls, text: str) -> GraphQuery:
        """``type:person importance:>0.5 from:a traverse:IS_A,PART_OF depth:2 limit:10 colour:red some name``. Bounds of
        importance are inclusive; other keys are properties; words without a colon are part of the name, case aside.
        A number that is none is a ValueError."""
        out, words = cls(), []
        for word in text.split():
            name, colon, value = word.partition(":")
            name = name.lower()
            if not colon:
                words.append(word)
            elif name == "type":
                out = out.where(F.col("type") == value)
            elif name == "importance":
                c = F.col("importance")
                out = out.where(c >= float(value[1:]) if value[:1] == ">" else c <= float(value[1:]) if value[:1] == "<" else c == float(value))
            elif name == "from":
                out = out.start(value)
            elif name == "traverse":
                out = replace(out, over=tuple(value.split(",")))
            elif name == "depth":
                out = replace(out, depth=int(value))
            elif name == "limit":
                out = replace(out, most=int(value))
            else:
                out = replace(out, properties=out.properties + ((name, value),))
        return out.where(F.contains(F.lower("name"), F.lit(" ".join(words).lower()))) if words else out

    def _fit(self, vertices: DataFrame) -> DataFrame:
        """A property is a column of that name, or an entry of a map column ``properties``; without either nothing fits."""
        conditions = list(self.wanted)
        for name, value in self.properties:
            plain, packed = name in vertices.columns, "properties" in vertices.columns
            conditions.append(F.col(name).cast("string") == value if plain else F.col("properties")[name].cast("string") == value if packed else F.lit(False))
        return vertices.where(reduce(Column.__and__, conditions)) if conditions else vertices

    def matches(self, vertices: DataFrame, edges: DataFrame, part: int | None = None) -> DataFrame:
        """(start, id, depth, score[, path]): every vertex once a start, at its least depth; score = importance * weight of
        the edge it was reached by / depth. Of several edges, or ways, of that depth the heaviest edge counts, then the first
        path in order. Starts score their importance at depth 0, and aren't among their own results. With ``distinct`` a
        vertex comes back once, for the smallest start."""
        fit = self._fit(vertices).select("id", "type", "name", "importance")
        starts = fit
        if self.ids:
            starts = starts.where(F.col("id").isin(list(self.ids)))
        if self.types:
            starts = starts.where(F.col("type").isin(list(self.types)))
        if self.name is not None:
            low = F.lower("name")
            starts = starts.where(F.contains(low, F.lit(self.name.lower())) if self.fuzzy else low == self.name.lower())
        if self.depth == 0 or (not self.over and self.depth == 1):
            own = [F.array("id").alias("path")] if self.paths else []
            return starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.col("importance").alias("score"), *own)
        e = edges.where(F.col("type").isin(list(self.over))) if self.over else edges
        e = e.where(reduce(Column.__and__, self.edges_wanted)) if self.edges_wanted else e
        e = directed(e.select("src", "dst", "weight"), self.direction).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        e = e.join(fit.select(F.col("id").alias("dst"), "importance"), "dst")
        step, hubs = split_hubs(cut(e), part)
        frontier = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path")).distinct())
        seen, found = frontier.select("start", "node"), []
        for depth in range(1, self.depth + 1):
            on = stepped(frontier, step, hubs).select("start", F.col("dst").alias("node"), "weight", "importance", *([F.concat("path", F.array("dst")).alias("path")] if self.paths else []))
            best = [F.max("weight").alias("weight"), F.first("importance").alias("importance")]
            if self.paths:
                best = [F.min(F.struct((-F.col("weight")).alias("w"), "path")).alias("b"), F.max("weight").alias("weight"), F.first("importance").alias("importance")]
            on = on.groupBy("start", "node").agg(*best).join(seen, ["start", "node"], "left_anti")
            score = F.col("importance") * F.col("weight") / depth
            frontier = cut(on.select("start", "node", F.lit(depth).alias("depth"), score.alias("score"), (F.col("b.path") if self.paths else F.array("node")).alias("path")))
            if frontier.isEmpty():
                break
            found.append(frontier)
            seen = seen.unionByName(frontier.select("start", "node"))
        out = reduce(DataFrame.unionByName, found) if found else frontier
        out = out.select("start", F.col("node").alias("id"), "depth", "score", *(["path"] if self.paths else []))
        if not self.once:
            return out
        rest = [c for c in out.columns if c not in ("id", "start")]
        return out.groupBy("id").agg(F.min(F.struct("start", *rest)).alias("m")).select("m.start", "id", *[f"m.{c}" for c in rest])

    def run(self, vertices: DataFrame, edges: DataFrame, part: int | None = None) -> DataFrame:
        """A page of the matches, with vertex columns, ``total`` matches and whether the page left some out behind it.
        Sorted by start and id where no key is given; ties likewise."""
        found = cut(self.matches(vertices, edges, part))
        total = found.agg(F.count("*").alias("total"))  # one row
        rows = found.join(vertices.drop(*[c for c in found.columns if c != "id"]), "id")
        key = [] if self.key is None else [F.lower("name") if self.key == "name" else F.col(self.key)]
        rows = rows.orderBy(*[k.desc() if self.descending else k for k in key], "start", "id").offset(self.skip)
        rows = rows if self.most is None else rows.limit(self.most)
        beyond = F.lit(False) if self.most is None else F.col("total") > self.skip + self.most
        return rows.crossJoin(F.broadcast(total)).withColumn("truncated", beyond)

    def aggregates(self, matches: DataFrame, vertices: DataFrame, *wanted: tuple[str, str]) -> DataFrame:
        """One row of (function, field) pairs over all matches: count, sum, avg, min, max; named function_field."""
        rows = matches.join(vertices.drop(*[c for c in matches.columns if c != "id"]), "id")
        return rows.agg(*[getattr(F, f)(field).alias(f"{f}_{field}") for f, field in wanted])
