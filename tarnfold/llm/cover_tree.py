"""Exact top-k inner products by dual-tree search over cover trees of queries and data.

The first level of both trees spans the cluster: data and queries are dealt to nodes around sampled centres, each with its
covering radius. A first round searches every group of queries in the node of the highest product; a second one only in
the nodes whose bound reaches the group's worst kth score so far, and prunes from these scores on. Inside a task, where a
block of data meets a group of queries, both have a cover tree of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.llm.vectors import best, matrix, usable
from tarnfold.session import cut

LEAF = 32
DATA_BLOCK = 2048
QUERY_BLOCK = 1024
CENTRES = 256
CHUNK = 512
LONG = (-(1 << 63), (1 << 63) - 1)


class CoverTree:
    """Top-down: a node of level i with point p takes p and then any point not yet covered as centres of level i - 1,
    until every point of the node lies within 2^(i-1) of a centre. So centres of a level are more than its radius apart
    (separation), each point stays a centre below (nesting), and children lie within 2^i of their parent (covering).
    A node of at most LEAF points, or of equal points, is a leaf. ``radius`` is the distance to the farthest descendant.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        if len(x):
            every = np.arange(len(x))
            self._grow(every, self._far(0, every))
        self.c, self.r = np.array(self.center, int), np.array(self.radius)
        self.norm = np.sqrt((x[self.c] ** 2).sum(1)) if len(x) else np.empty(0)

    def _far(self, p: int, at: np.ndarray) -> np.ndarray:
        d = self.x[at] - self.x[p]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _grow(self, at: np.ndarray, far: np.ndarray) -> int:
        """Iterative over levels where a node has one child only, so equal or nested points don't deepen the recursion."""
        node, p, radius = len(self.center), int(at[0]), float(far.max())
        self.center.append(p), self.radius.append(radius), self.children.append([]), self.points.append(at)
        if len(at) <= LEAF or radius == 0:
            return node
        reach = 2.0 ** (np.ceil(np.log2(radius)) - 1)
        kids = []
        while True:
            kids, left, dist = [], at, far
            while len(left):
                near = dist <= reach
                kids.append((left[near], dist[near]))
                left = left[~near]
                dist = self._far(int(left[0]), left) if len(left) else left
            if len(kids) > 1:
                break
            reach /= 2
        self.points[node] = at[:0]
        self.children[node] = [self._grow(a, d) for a, d in kids]
        return node


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows: in floating point where every sum stays exact, else in integers; beyond 64 bits
    the nearest that 64 bits hold."""
    largest = lambda a: max(int(a.max(initial=0)), -int(a.min(initial=0)))
    most = largest(x) * largest(y) * max(1, x.shape[1])
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return x @ y.T
    return np.array([[min(max(v, LONG[0]), LONG[1]) for v in row] for row in (x.astype(object) @ y.astype(object).T).tolist()], np.int64).reshape(len(x), len(y))


def dual_top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, known: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (scores, ids) of its k highest integer inner products, its own id aside, ties to smaller ids.
    ``known``: the kth best score that a query has from elsewhere; lower ones are left out."""
    top = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
    worst = np.full(len(q_ids), -np.inf) if known is None else known.astype(np.float64) * np.where(known > 0, 1 - 1e-15, 1 + 1e-15)
    qt, xt = CoverTree(q.astype(np.float64)), CoverTree(x.astype(np.float64))
    if not len(q_ids) or not len(ids):
        return top

    def bounds(n: int, nodes: np.ndarray) -> np.ndarray:
        """No inner product of a query below n and a point below a node is more."""
        dots = xt.x[xt.c[nodes]] @ qt.x[qt.c[n]]
        ub = dots + qt.r[n] * xt.norm[nodes] + xt.r[nodes] * qt.norm[n] + qt.r[n] * xt.r[nodes]
        return ub + 1e-9 * (np.abs(dots) + 1) + 1e-9 * (qt.norm[n] + qt.r[n]) * (xt.norm[nodes] + xt.r[nodes])

    def below(n: int) -> np.ndarray:
        stack, out = [n], []
        while stack:
            m = stack.pop()
            out.append(qt.points[m]), stack.extend(qt.children[m])
        return np.concatenate(out)

    def go(n: int, nodes: np.ndarray) -> None:
        own = below(n)
        ub = bounds(n, nodes)
        nodes = nodes[ub >= worst[own].min()]
        # data nodes wider than this query node open first
        open_ = np.array([bool(xt.children[m]) and (not qt.children[n] or xt.r[m] >= qt.r[n]) for m in nodes], bool)
        while open_.any():
            kids = np.array([c for m in nodes[open_] for c in xt.children[m]], int)
            kids = kids[bounds(n, kids) >= worst[own].min()]
            nodes = np.concatenate([nodes[~open_], kids])
            open_ = np.array([bool(xt.children[m]) and (not qt.children[n] or xt.r[m] >= qt.r[n]) for m in nodes], bool)
        if qt.children[n]:
            for child in qt.children[n]:
                go(child, nodes)
            return
        ub = bounds(n, nodes)
        order = np.argsort(-ub, kind="stable")
        nodes, ub = nodes[order], ub[order]
        at = 0
        while at < len(nodes) and ub[at] >= worst[own].min():
            held, end = 0, at
            while end < len(nodes) and (end == at or held < CHUNK):
                held += len(xt.points[nodes[end]])
                end += 1
            points = np.concatenate([xt.points[m] for m in nodes[at:end]])
            scores = _exact(q[own], x[points])
            for row, i in enumerate(own):
                able = (scores[row] >= worst[i]) & (ids[points] != q_ids[i])
                if able.any():
                    s, d = np.concatenate([top[i][0], scores[row][able]]), np.concatenate([top[i][1], ids[points][able]])
                    first = best(s, d, k)
                    top[i] = (s[first], d[first])
                    if len(first) == k:
                        worst[i] = top[i][0][-1]
            at = end

    go(0, np.array([0]))
    return top


def _dealt(rows: DataFrame, centres: list[list[float]], columns: list[str]) -> DataFrame:
    """Rows with their length, the nearest centre of that length ("node"; -1 without one) and how far it is."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(c) for c in centres}:
        at = [i for i, c in enumerate(centres) if len(c) == d]
        by_length[d] = np.array(at), np.array([centres[i] for i in at], np.float64).reshape(len(at), d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64)
            node, far = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                if d in by_length:
                    at, c = by_length[d]
                    x = matrix(batch.column("v").take(pa.array(own)), len(own)).astype(np.float64)
                    near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
                    gap = x - c[near]
                    node[own], far[own] = at[near], np.sqrt((gap * gap).sum(1)) * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(lengths), pa.array(node), pa.array(far)], names=[*columns, "dim", "node", "far"])

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in columns)
    return rows.select(columns).mapInArrow(work, f"{schema}, dim long, node int, far double")


def _centres(rows: DataFrame, n: int, block: int) -> list[list[float]]:
    """As many as there will be blocks, CENTRES at most: the vectors of the least hash."""
    chosen = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(CENTRES, max(1, -(-n // block)))).collect()
    return [[float(x) for x in r["v"]] for r in chosen]


def _blocks(dealt: DataFrame, block: int) -> DataFrame:
    """(dim, node, radius, subs): covering radius of a node, and in how many blocks its rows go."""
    return dealt.groupBy("dim", "node").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("subs"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of (vec_id, v array<long>) tables, each query's k highest inner products.

    Both sides are cut by nodes around at most CENTRES sampled centres, large nodes further by hash; a task has one block of
    each, builds their trees and returns k rows a query, and a window over these few rows merges. Memory is bounded by the
    blocks; work is bounded by pruning. Vectors of another length than the query's are no candidates. Every row of a
    repeated id is a candidate, and a query under its id. Scores beyond 64 bits are the nearest that 64 bits hold. Ties go
    to the smaller id; a query has all candidates where they are fewer than k; empty tables give no rows.
    """
    n, m = vectors.count(), queries.count()
    spark = vectors.sparkSession
    centres, groups = _centres(vectors, n, data_block), _centres(queries, m, query_block)
    data = _dealt(vectors, centres, ["vec_id", "v"])
    # rows of one id are one query block's, so the number of a query's row tells it from others of its id
    asked = _dealt(cut(queries.withColumn("row", F.monotonically_increasing_id())), groups, ["row", "vec_id", "v"])
    data, asked = cut(data), cut(asked)
    d_nodes, q_nodes = _blocks(data, data_block).collect(), _blocks(asked, query_block).collect()  # a row a centre and length
    pairs, at = [], np.array
    for q in q_nodes:
        c = at(groups[q["node"]]) if q["node"] >= 0 else None
        found = []
        for d in (d for d in d_nodes if d["dim"] == q["dim"]):
            if c is None or d["node"] < 0:
                found.append((0.0, float("inf"), d))
                continue
            o = at(centres[d["node"]])
            dot, cn, on = float(c @ o), float(np.sqrt(c @ c)), float(np.sqrt(o @ o))
            most = dot + q["radius"] * on + d["radius"] * cn + q["radius"] * d["radius"]
            found.append((dot, most + 1e-9 * (cn + q["radius"]) * (on + d["radius"]), d))
        found.sort(key=lambda f: (f[2]["node"] >= 0, -f[0], f[2]["node"]))
        pairs += [(q["dim"], q["node"], q["subs"], d["node"], d["subs"], most, i == 0 or d["node"] < 0) for i, (_, most, d) in enumerate(found)]
    table = spark.createDataFrame(pairs, "dim long, q_node int, q_subs int, d_node int, d_subs int, most double, first boolean")
    each = lambda of, name: F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(name)
    table = table.select("*", each("q_subs", "q_sub")).select("*", each("d_subs", "d_sub"))
    sub = lambda subs, salt, *of: F.pmod(F.xxhash64(F.lit(salt), *of), F.col(subs)).cast("int")

    def work(block: pa.Table) -> pa.Table:
        row = block["row"]
        mine = ~row.is_null().to_numpy()
        x, ids = matrix(block["v"], len(mine)).astype(np.int64), block["vec_id"].to_numpy()
        known = np.array([LONG[0] if v is None else v for v in block["known"].filter(pa.array(mine)).to_pylist()], np.int64)
        found = dual_top_k(ids[mine], x[mine], ids[~mine], x[~mine], k, np.where(known == LONG[0], -np.inf, known.astype(np.float64)))
        count = [len(s) for s, _ in found]
        cols = [np.repeat(x, count) for x in (row.filter(pa.array(mine)).to_numpy(), ids[mine])] + [np.concatenate([f[j] for f in found] + [np.empty(0, np.int64)]) for j in (1, 0)]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["row", "query_id", "vec_id", "score"])

    def searched(tasks: DataFrame, q_rows: DataFrame) -> DataFrame:
        """Blocks of ``tasks`` (dim, q_node, q_sub, d_node, d_sub); queries carry the kth score they have."""
        tasks = cut(tasks)
        tasks = F.broadcast(tasks) if tasks.count() <= 500_000 else tasks
        keys = ["dim", "q_node", "q_sub", "d_node", "d_sub"]
        sizes = spark.createDataFrame([(d["dim"], d["node"], d["subs"]) for d in d_nodes], "dim long, d_node int, d_subs int")
        left = data.withColumnRenamed("node", "d_node").join(F.broadcast(sizes), ["dim", "d_node"]).withColumn("d_sub", sub("d_subs", 1, "vec_id", "v"))
        nobody = F.lit(None).cast("long")
        left = left.join(tasks, ["dim", "d_node", "d_sub"]).select(*keys, "vec_id", "v", nobody.alias("row"), nobody.alias("known"))
        right = q_rows.join(tasks, ["dim", "q_node", "q_sub"]).select(*keys, "vec_id", "v", "row", "known")
        return left.unionByName(right).groupBy(keys).applyInArrow(work, "row long, query_id long, vec_id long, score long")

    q_sizes = spark.createDataFrame([(q["dim"], q["node"], q["subs"]) for q in q_nodes], "dim long, q_node int, q_subs int")
    q_rows = cut(asked.withColumnRenamed("node", "q_node").join(F.broadcast(q_sizes), ["dim", "q_node"]).withColumn("q_sub", sub("q_subs", 2, "row")).withColumn("known", F.lit(None).cast("long")))
    keys = ["dim", "q_node", "q_sub", "d_node", "d_sub"]
    parts = cut(searched(table.where("first").select(keys), q_rows))
    if any(not p[-1] for p in pairs):
        # the kth score of each query so far, and the worst of a group: none where a query has fewer
        nth = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        kth = parts.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == k).select("row", F.col("score").alias("known"))
        q_rows = cut(q_rows.drop("known").join(kth, "row", "left"))
        worst = q_rows.groupBy("dim", "q_node", "q_sub").agg(F.when(F.count("known") == F.count("*"), F.min("known")).alias("worst"))
        rest = table.where("not first").join(worst, ["dim", "q_node", "q_sub"]).where("worst is null or most >= worst").select(keys)
        parts = parts.unionByName(searched(rest, q_rows))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(vectors: DataFrame, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) with floor(scale * x) of each component as double (beyond 64 bits the nearest that 64 bits
    hold). Null vectors, vectors with a null or non-finite component and null ids go; repeated ids stay, a row each; other
    columns are ignored."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def op3_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 100, against all rows."""
    rows = cut(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(rows, rows.where("vec_id % 100 = 0"), 10)
