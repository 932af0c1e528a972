"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists of shingles.

Plan, with whole shingle sets and every document:

1. Classes: equal texts (md5) meet in one aggregate; one document stands for each.
2. One pass over the texts that stand: each task packs its (64-bit shingle, document) postings, a row a hash range of
   shingles ("bucket"), and its documents' set sizes. A bucket counts document frequencies. Shingles of one document
   cannot link anything: only the others go on, packed by groups of documents.
3. Rarest first: under that order two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of either. A
   document with that many shingles of its own is linked with nothing and leaves here; of the others these prefix
   shingles make candidate lists. Equal lists are one list.
4. T-occurrence search checks candidates: for a query of n shingles the lists of its shingles are split by DivideSkip, the
   short ones merged by a heap, the long ones probed by binary search, and documents that reach the required overlap,
   ceil(t / (1 + t) (n + m)), are links. First, in two rounds, one pivot of each list is searched among the list's others;
   a pivot then leaves its lists, and lists of one component end. What is left of a list is searched in chunks: chunks of
   its largest component against the other documents, and these against each other.
5. Components over the links and the classes.

Links are passed on as spanning forests of each task, never as all pairs of a group.
"""

from __future__ import annotations

import heapq
import math
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators.components import connected_components
from tarnfold.llm.text import each, mix, shingles, tidy
from tarnfold.session import cut

BUCKET_BYTES = 4_500_000
GROUP_BYTES = 6_000_000
CHUNK_TOKENS = 1_000_000
BLOCK_DOCS = 128
BLOCK_TOKENS = 2_000_000
HOOD_DOCS = 4096
ROUNDS = 2
ROWS_A_TASK = 50_000
#: Node numbers above all documents' ids: for a second text of one id, and for texts without an id (which link nothing).
SECOND, NAMELESS = 2 << 61, 3 << 61


def fraction(threshold: float) -> tuple[int, int]:
    """The threshold as a ratio of small integers, so that comparisons are exact: 0.85 -> (17, 20)."""
    f = Fraction(threshold).limit_denominator(10_000)
    return f.numerator, f.denominator


def prefix_length(n: int, num: int, den: int) -> int:
    """n - ceil(t n) + 1"""
    return n - -(-n * num // den) + 1


def needed(n: int, m: int, num: int, den: int) -> int:
    """Least overlap of sets of n and m for similarity t: ceil(t / (1 + t) (n + m))."""
    return -(-num * (n + m) // (num + den))


# ---------------------------------------------------------------- T-occurrence search in one task


def divide_skip(lists: list[list[int]], need: int, mu: float = 0.0085, skip: Callable[[int], bool] | None = None) -> dict[int, int]:
    """Ids that occur in at least ``need`` of the sorted lists, with their counts. The L longest lists are only probed; ids
    that ``skip`` names are not probed for, and left out."""
    lists = sorted((x for x in lists if x), key=len)
    if need <= 0 or len(lists) < need:
        return {}
    longest = len(lists[-1])
    n_long = min(need - 1, len(lists), int(need / (mu * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :][::-1]
    found: dict[int, int] = {}
    least, last, count = need - n_long, -1, 0
    merged = heapq.merge(*short) if len(short) > 1 else iter(short[0] if short else ())
    for x in (*merged, -2):
        if x == last:
            count += 1
            continue
        if last >= 0 and count >= least and not (skip and skip(last)):
            for k, probe in enumerate(long):
                i = bisect_left(probe, last)
                count += i < len(probe) and probe[i] == last
                if count + len(long) - k - 1 < need:
                    break
            if count >= need:
                found[last] = count
        last, count = x, 1
    return found


class Forest:
    """Union-find that reports the edges that joined something."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int, edge: bool = True) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            if edge:
                self.edges.append((a, b))


def search(index: list[tuple[int, int, np.ndarray]], queries: list[tuple[int, int, np.ndarray]] | None, num: int, den: int, known: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links (u, v) that span what links join, between ``queries`` and ``index`` (or within it): each document is
    (id, set size, its shared shingles). ``known``: component of ids so far; links inside one are left out."""
    forest = Forest()
    for d, c in (known or {}).items():
        forest.join(d, c, edge=False)
    index = sorted(index, key=lambda d: (d[1], d[0]))
    lists: dict[int, list[int]] = {}
    ids, sizes = [d[0] for d in index], [d[1] for d in index]
    within = queries is None
    if not within:
        asked = np.unique(np.concatenate([q[2] for q in queries])) if queries else np.empty(0, np.uint64)
        for i, (_, _, tokens) in enumerate(index):
            for x in tokens[np.isin(tokens, asked, assume_unique=True)].tolist():
                lists.setdefault(x, []).append(i)
    for i, (d, n, tokens) in enumerate(index if within else queries):
        own = [lists[x] for x in tokens.tolist() if x in lists]
        # no partner is smaller than ceil(t n), so none is reached with fewer than ceil(t n) hits from a larger one
        least = -(-n * num // den)
        for j, count in divide_skip(own, needed(n, least, num, den), skip=lambda j, d=d: forest.root(ids[j]) == forest.root(d)).items():
            m = sizes[j]
            if ids[j] != d and count >= needed(n, m, num, den):
                forest.join(d, ids[j])
        if within:
            for x in tokens.tolist():
                lists.setdefault(x, []).append(i)
    return forest.edges


# ---------------------------------------------------------------- packed numbers

_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*parts: np.ndarray) -> bytes:
    """Unsigned numbers, bytes of one place together, compressed."""
    head = struct.pack(f"<{1 + 2 * len(parts)}q", len(parts), *[x for p in parts for x in (len(p), p.dtype.itemsize)])
    return _ZIP.compress(head + b"".join(p.view(np.uint8).reshape(-1, p.dtype.itemsize).T.tobytes() for p in parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = _UNZIP.decompress(data)
    (k,) = struct.unpack_from("<q", raw)
    shape, at, out = struct.unpack_from(f"<{2 * k}q", raw, 8), 8 + 16 * k, []
    for n, size in zip(shape[::2], shape[1::2]):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(f"u{size}").ravel())
        at += n * size
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Ascending 64-bit numbers as differences; ``sums`` is the way back."""
    return np.diff(x.view(np.uint64), prepend=np.uint64(0))


def sums(x: np.ndarray, kind=np.uint64) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64).view(kind)


def _groups(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


# ---------------------------------------------------------------- postings by bucket, then by group of documents


def _blobs(size: int, buckets: int):
    """(bucket, data) of (uid, text): a row a chunk of documents and bucket of its shingles, and one of its set sizes (under
    a bucket below 0)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.array(sorted(chunk), np.int64)
            sets = [chunk[i] for i in ids.tolist()]
            n = np.array([len(s) for s in sets], np.uint32)
            live, rows = [-1 - int(ids[0]) % buckets], [pack(gaps(ids), n)]
            named = int(np.searchsorted(ids, NAMELESS))
            if named:
                tokens, own = np.concatenate(sets[:named]), np.repeat(np.arange(named, dtype=np.uint32), n[:named])
                by = np.argsort(tokens)
                tokens, own = tokens[by], own[by]
                # buckets are ranges of the hash
                bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                at = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(at[1:] > at[:-1]).tolist():
                    used, where = np.unique(own[at[b] : at[b + 1]], return_inverse=True)
                    live.append(b)
                    rows.append(pack(gaps(tokens[at[b] : at[b + 1]]), where.astype(np.uint32), gaps(ids[used])))
            return pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for d, text in zip(each(batch.column("uid")), each(batch.column("text"))):
                if d not in chunk:  # one node has one text
                    chunk[d] = s = shingles(text, size)
                    held += len(s)
                if held >= CHUNK_TOKENS:
                    yield flush()
                    chunk, held = {}, 0
        if chunk:
            yield flush()
        chunk = {}
        tidy()

    return work


SHARED = "kind int, part int, data binary"


def _shared(groups: int):
    """One bucket: postings of shingles that at least two documents have, with document frequencies (kind 0), and sizes
    (kind 1), a row a group of documents."""

    def by_group(ids: np.ndarray, pick) -> Iterator[tuple[int, bytes]]:
        g = _groups(ids, groups)
        by = np.argsort(g, kind="stable")
        at = np.searchsorted(g[by], np.arange(groups + 1))
        for k in np.flatnonzero(at[1:] > at[:-1]).tolist():
            yield k, pick(by[at[k] : at[k + 1]])

    def work(table: pa.Table) -> pa.Table:
        kind = 0 if table["bucket"][0].as_py() >= 0 else 1
        found: list[tuple[int, bytes]] = []
        if kind:
            for data in table["data"].to_pylist():
                ids, n = unpack(data)
                ids = sums(ids, np.int64)
                found += by_group(ids, lambda own: pack(gaps(ids[own]), n[own]))
        else:
            tokens, docs = [], []
            for data in table["data"].to_pylist():
                t, own, ids = unpack(data)
                tokens.append(sums(t)), docs.append(sums(ids, np.int64)[own])
            t, d = np.concatenate(tokens), np.concatenate(docs)
            by = np.lexsort((d, t))
            t, d = t[by], d[by]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])  # repeated rows
            t, d = t[new], d[new]
            _, df = np.unique(t, return_counts=True)
            df = np.repeat(df, df).astype(np.uint32)
            t, d, df = t[df > 1], d[df > 1], df[df > 1]

            def picked(own: np.ndarray) -> bytes:
                ids, where = np.unique(d[own], return_inverse=True)
                return pack(gaps(t[own]), where.astype(np.uint32), gaps(ids), df[own])

            found += by_group(d, picked)
        return pa.table({"kind": pa.array([kind] * len(found), pa.int32()), "part": pa.array([k for k, _ in found], pa.int32()), "data": pa.array([x for _, x in found], pa.binary())})

    return work


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            ids, n = unpack(data)
            yield pa.RecordBatch.from_arrays([pa.array(sums(ids, np.int64)), pa.array(n.astype(np.int64))], names=["uid", "n"])


NEAR = "uid long, n long, prefix array<long>, codes binary"


def _assembled(num: int, den: int):
    """One group of documents: those with a prefix shingle that others have, (uid, set size, such prefix shingles, all
    shared shingles)."""

    def work(table: pa.Table) -> pa.Table:
        ids, n, docs, codes, dfs = [], [], [], [], []
        for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
            if kind:
                i, k = unpack(data)
                ids.append(sums(i, np.int64)), n.append(k)
            else:
                t, own, i, df = unpack(data)
                codes.append(sums(t)), docs.append(sums(i, np.int64)[own]), dfs.append(df)
        out: list[tuple[int, int, np.ndarray, bytes]] = []
        if codes:
            ids, at = np.unique(np.concatenate(ids), return_index=True)
            n = np.concatenate(n)[at].astype(np.int64)
            d, t, df = np.concatenate(docs), np.concatenate(codes), np.concatenate(dfs)
            by = np.lexsort((t, df, d))
            d, t = d[by], t[by]
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            size = n[np.searchsorted(ids, d[starts])]
            shared = np.diff(np.r_[starts, len(d)])
            left = size - -(-size * num // den) + 1 - (size - shared)
            for k in np.flatnonzero(left > 0).tolist():
                own = t[starts[k] : starts[k] + shared[k]]
                out.append((int(d[starts[k]]), int(size[k]), own[: left[k]].view(np.int64), pack(gaps(np.sort(own)))))
        lists = pa.array([x[2] for x in out], pa.list_(pa.int64()))
        return pa.table({"uid": pa.array([x[0] for x in out], pa.int64()), "n": pa.array([x[1] for x in out], pa.int64()), "prefix": lists, "codes": pa.array([x[3] for x in out], pa.binary())})

    return work


# ---------------------------------------------------------------- checking candidates

UNIT = ["code", "a", "b"]


def _searched(num: int, den: int):
    """One task: sets of documents (rows with codes), and units (code, a, b) of them: side 0 is the index, side 1 has the
    queries; a unit with no side 1 is searched within."""

    def work(table: pa.Table) -> pa.Table:
        sets: dict[int, tuple[int, int, np.ndarray]] = {}
        units: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        for uid, n, codes, code, a, b, side, comp in zip(*[table[c].to_pylist() for c in ("uid", "n", "codes", *UNIT, "side", "comp")]):
            if codes is not None:
                sets[uid] = (uid, n, sums(unpack(codes)[0]))
            else:
                units.setdefault((code, a, b), []).append((side, uid, comp))
        links: list[tuple[int, int]] = []
        for key in sorted(units):
            rows = units[key]
            index, queries = [sets[u] for side, u, _ in rows if not side], [sets[u] for side, u, _ in rows if side]
            links += search(index, queries or None, num, den, {u: c for _, u, c in rows})
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return work


def _spread(small: DataFrame, rows: int = 500_000) -> DataFrame:
    """Broadcast only where it is known to be small; else Spark joins by shuffle."""
    return F.broadcast(small) if small.count() <= rows else small


def _cut(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` of at most about ``rows`` rows, in no more files than they are worth."""
    return cut(df.coalesce(max(1, -(-rows // ROWS_A_TASK))))


def _checked(units: DataFrame, rows: int, near: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) of units (code, a, b, side, uid, n, comp), about ``rows`` of them. Units are dealt to tasks by hash, as many as hold about
    BLOCK_TOKENS of sets each; a task gets a set once, however many of its units have it."""
    units = _cut(units, rows)
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(64, -(-int(total) // BLOCK_TOKENS))
    units = units.withColumn("task", F.pmod(F.xxhash64(*UNIT), F.lit(tasks)))
    sets = units.select("task", "uid").distinct().join(near.select("uid", "n", "codes"), "uid")
    tasked = sets.unionByName(units.drop("n"), allowMissingColumns=True)
    return cut(tasked.groupBy("task").applyInArrow(_searched(num, den), "u long, v long").coalesce(tasks))


def _compatible(n: Column, m: Column, num: int, den: int) -> Column:
    """Sizes whose sets may have the similarity."""
    return F.greatest(n, m) * num <= F.least(n, m) * den


def _chunks(docs: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(tokens / BLOCK_TOKENS), F.lit(1)).cast("int")


def _in_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with their component by ``links``, of lists that still have two components."""
    rows = members.count()
    found = cut(connected_components(links, rows=links.count()).withColumnRenamed("node", "uid"))
    members = _cut(members.drop("comp").join(_spread(found), "uid", "left").select("code", "uid", "n", F.coalesce("component", "uid").alias("comp")), rows)
    open_ = _cut(members.groupBy("code").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("code"), rows)
    return _cut(members.join(_spread(open_), "code"), rows)


def _pivot_round(members: DataFrame, near: DataFrame, salt: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links, members without the pivots): of each list the document of the least hash is searched among the others."""
    rows = members.count()
    pivots = members.groupBy("code").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "uid").alias("h"), "uid", "n", "comp")).alias("p"))
    pivots = _cut(pivots.select("code", F.col("p.uid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pc")), rows)
    rest = _cut(members.join(_spread(pivots), "code").where("uid <> pivot"), rows)
    pairs = _cut(rest.where(F.col("comp") != F.col("pc")).where(_compatible(F.col("n"), F.col("pn"), num, den)).select("pivot", "pn", "pc", "uid", "n", "comp").distinct(), rows)
    # a unit is a pivot with a chunk of the others
    sizes = _cut(pairs.groupBy("pivot", "pn", "pc").agg(_chunks(F.count("*"), F.sum("n")).alias("chunks")), rows)
    chunk = F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int").alias("a")
    others = pairs.join(_spread(sizes.select("pivot", "chunks")), "pivot").select(F.col("pivot").alias("code"), chunk, F.lit(0).alias("b"), F.lit(0).alias("side"), "uid", "n", "comp")
    own = sizes.select(F.col("pivot").alias("code"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("side"), F.col("pivot").alias("uid"), F.col("pn").alias("n"), F.col("pc").alias("comp"))
    used = others.select("code", "a").distinct()
    return _checked(others.unionByName(own.join(used, ["code", "a"], "left_semi")), rows, near, num, den), rest.select("code", "uid", "n", "comp")


def _neighbourhoods(members: DataFrame) -> DataFrame:
    """``members`` with lists that share documents taken as one list, so that none of its pairs is met twice. Lists of a
    neighbourhood of over HOOD_DOCS documents stay as they are."""
    n = members.count()
    stars = _cut(members.groupBy("code").agg(F.min("uid").alias("v")), n)
    hoods = connected_components(members.join(_spread(stars), "code").select(F.col("uid").alias("u"), "v"), rows=n)
    hoods = cut(hoods.select(F.col("node").alias("uid"), F.col("component").alias("hood")))
    rows = _cut(members.join(_spread(hoods), "uid"), n)
    docs = rows.select(F.col("hood").alias("code"), "uid", "n", "comp").distinct()
    small = _spread(_cut(docs.groupBy("code").agg(F.count("*").alias("k")).where(F.col("k") <= HOOD_DOCS).select(F.col("code").alias("hood")), n))
    one = docs.join(small, docs["code"] == small["hood"], "left_semi")
    return _cut(one.unionByName(rows.join(small, "hood", "left_anti").select("code", "uid", "n", "comp")), n)


def _whole_lists(members: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components of each list: chunks of its largest component against chunks of the others, the
    others among themselves."""
    members = _neighbourhoods(members)
    n = members.count()
    per = members.groupBy("code", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    per = per.groupBy("code").agg(F.max(F.struct("k", "comp", "w")).alias("m"), F.sum("k").alias("k"), F.sum("w").alias("w"))
    per = _cut(per.select("code", F.col("m.comp").alias("main"), _chunks(F.col("m.k"), F.col("m.w")).alias("mains"), _chunks(F.col("k") - F.col("m.k"), F.col("w") - F.col("m.w")).alias("others")), n)
    rows = members.join(_spread(per), "code")
    of_main = F.col("comp") == F.col("main")
    c = F.pmod(F.xxhash64(F.lit(1), "uid"), F.when(of_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    m, o, none = F.col("mains"), F.col("others"), F.array().cast("array<int>")
    one = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    # units (a, b): a main chunk or an earlier other chunk, b an other chunk; an other chunk is also searched within
    as_main = F.transform(F.sequence(F.lit(0), o - 1), lambda b: one(F.col("c"), b, 0))
    as_other = F.concat(
        F.transform(F.sequence(F.lit(0), m - 1), lambda a: one(a, F.col("c"), 1)),
        F.array(one(m + F.col("c"), F.col("c"), 0)),
        F.transform(F.when(F.col("c") > 0, F.sequence(F.lit(0), F.col("c") - 1)).otherwise(none), lambda a: one(m + a, F.col("c"), 1)),
        F.transform(F.when(F.col("c") < o - 1, F.sequence(F.col("c") + 1, o - 1)).otherwise(none), lambda b: one(m + F.col("c"), b, 0)),
    )
    units = rows.withColumn("c", c).select("code", "uid", "n", "comp", F.explode(F.when(of_main, as_main).otherwise(as_other)).alias("t"))
    return _checked(units.select("code", "t.a", "t.b", "t.side", "uid", "n", "comp"), n, near, num, den)


# ---------------------------------------------------------------- the join


def link_documents(docs: DataFrame, size: int = 4, threshold: float = 0.85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link when their distinct ``size``-word shingles have a
    Jaccard similarity of at least ``threshold``; the component is the smallest id reachable by links.

    Words: A-Z lower-cased runs of anything but ASCII white space. A text of fewer words is one shingle. Null, empty and
    blank texts have no shingles, are linked with nothing and stand for themselves. Repeated rows come back each, with
    their own n_shingles; where one doc_id has different texts, each links by itself and the id has the links of all. A
    null id cannot be named: its row comes back with a null component and takes no part. An empty table gives no rows.
    Other columns are ignored. Ids are under 2^62. Shingles are told apart by 64-bit hashes.
    """
    num, den = fraction(threshold)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5("text"))))
    keys = cut(rows.select("doc_id", "h", F.octet_length("text").alias("bytes")))

    # 1. classes of equal texts; the least id stands for the class, under a number of its own if it has another text
    n_rows = keys.count()
    classes = _cut(keys.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("bytes").alias("bytes")), n_rows)
    second = _cut(classes.where("rep is not null").groupBy("rep").agg(F.count("*").alias("k"), F.min("h").alias("first")).where("k > 1"), n_rows)
    hashed = lambda *c: F.xxhash64(*c).bitwiseAND((1 << 61) - 1)
    many = not second.isEmpty()
    uid = F.when(F.col("doc_id").isNull(), hashed("h") + NAMELESS).when((F.col("h") != F.col("first")) if many else F.lit(False), hashed("doc_id", "h") + SECOND).otherwise(F.col("doc_id"))

    def numbered(df: DataFrame) -> DataFrame:
        """(doc_id, h, ...) of representatives with their node number."""
        return df.join(_spread(second.select(F.col("rep").alias("doc_id"), "first")), "doc_id", "left").withColumn("uid", uid).drop("first") if many else df.withColumn("uid", uid)

    repeated = classes.where("copies > 1 and rep is not null").select("h", "rep")
    copies = _cut(keys.where("h is not null and doc_id is not null").join(_spread(repeated), "h").where("doc_id <> rep").select("doc_id", "h", "rep").distinct(), n_rows)
    classes = _cut(numbered(classes.withColumnRenamed("rep", "doc_id")), n_rows)
    same = copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).unionByName(classes.where(F.col("uid").between(SECOND, NAMELESS - 1)).select(F.col("uid").alias("u"), F.col("doc_id").alias("v")))
    # a copy of a text that stands under a number of its own links to that number as well, through its id

    # 2. shingles that several texts share
    total = int(classes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    buckets, groups = max(16, -(-total // BUCKET_BYTES)), max(16, -(-total // GROUP_BYTES))
    stand = rows.where("h is not null").join(_spread(copies.select("doc_id", "h")), ["doc_id", "h"], "left_anti")
    blobs = numbered(stand).select("uid", "text").mapInArrow(_blobs(size, buckets), "bucket long, data binary")
    shared = cut(blobs.groupBy("bucket").applyInArrow(_shared(groups), SHARED).coalesce(2 * buckets))

    # 3. candidate lists: documents of a prefix shingle
    near = cut(shared.groupBy("part").applyInArrow(_assembled(num, den), NEAR).coalesce(groups))
    prefixes = near.select("uid", "n", F.explode("prefix").alias("code"))
    lists = prefixes.groupBy("code").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("y")).where("k > 1")
    lists = _spread(cut(lists.groupBy("k", "x", "y").agg(F.min("code").alias("code")).select("code")))
    members = cut(prefixes.join(lists, "code").select("code", "uid", "n", F.col("uid").alias("comp")))

    # 4. links
    links = members.sparkSession.createDataFrame([], "u long, v long")
    for salt in range(ROUNDS):
        if members.isEmpty():
            break
        more, members = _pivot_round(members, near, salt, num, den)
        links = links.unionByName(more)
        members = _in_components(members, links)
    if not members.isEmpty():
        links = links.unionByName(_whole_lists(members, near, num, den))

    # 5. components
    found = cut(connected_components(links.unionByName(same), rows=links.count() + n_rows).select(F.col("node").alias("doc_id"), "component"))
    sizes = shared.where("kind = 1").mapInArrow(_sizes, "uid long, n long").groupBy("uid").agg(F.max("n").alias("n"))
    sized = classes.join(sizes, "uid").select("h", "n")
    out = keys.join(sized, "h", "left").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one document of each group of linked ones: that of the smallest id.

    All columns come back as they were, whatever their names. Rows of null, empty or blank text and of a null id stay;
    repeated rows of one id stay or go together; an empty table gives no rows (see ``link_documents``).
    """
    found = _spread(cut(link_documents(docs, size, threshold, key, text).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()))
    return docs.join(found, docs[key] == found["_gone"], "left_anti")


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; 4-word shingles, similarity of at least 0.85."""
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
