"""Exact, near and fuzzy duplicates; clusters, keepers and merges; conflicts between similar texts."""

from __future__ import annotations

import difflib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.functions import text as tx
from tarnfold.operators.components import connected_components
from tarnfold.session import cut


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(content_hash, first, members) of texts that several rows share."""
    got = docs.groupBy(tx.content_hash(F.col(text)).alias("content_hash")).agg(F.min(key).alias("first"), F.count("*").alias("members"))
    return got.where("members > 1")


def keepers(docs: DataFrame, group: Column, strategy: str, key: str = "doc_id", created: str = "created_at", confidence: str = "confidence") -> DataFrame:
    """(key, keep) of every row: one keeper a group, by newest, oldest or confidence, the smaller key among equals.
    One aggregate by group and one join back on it; both survive a hot group."""
    order = {"newest": F.struct(F.col(created), -F.col(key)), "oldest": F.struct(-F.unix_micros(F.col(created).cast("timestamp")), -F.col(key)), "confidence": F.struct(F.col(confidence), -F.col(key))}[strategy]
    rows = docs.select(key, group.alias("_g"), order.alias("_o"))
    best = rows.groupBy("_g").agg(F.max_by(key, "_o").alias("_k"))
    return rows.join(best, "_g").select(key, (F.col(key) == F.col("_k")).alias("keep"))


#: Counters that words are hashed to (their order by rarity may be rough), words that similar sets must share among the first,
#: documents of a group that a task holds against each other, documents whose words a task's group has at most or so.
SLOTS, SHARED, TOGETHER, BUCKET = 1 << 20, 3, 512, 1000


def _rare_first(counts: np.ndarray, threshold: float):
    """(x, i) of each set's first words, rare ones first; words that no other row has are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h = b["h"].value_lengths().to_numpy().astype(np.int64), b["h"].flatten().to_numpy()
            row, seen = np.repeat(np.arange(len(n)), n), counts[h & (SLOTS - 1)]
            order = np.lexsort((h, seen, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            most = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + SHARED
            keep = (place < most[row]) & (seen[order] > 1)
            at = row[keep]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), pa.array(n[at].astype(np.int32)), pa.array(h[order][keep]), pa.array((place[keep] + 1).astype(np.int32))], names=["id", "n", "x", "i"])

    return work


def _set_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: see near_pairs."""
    slots = sets.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).agg(F.count("*").alias("c")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["c"].to_numpy()
    step = math.log(1 / threshold) * (1 + 1e-9)
    kind = dict(sets.dtypes)["id"]
    first = sets.mapInArrow(_rare_first(np.minimum(counts, 2**31 - 1).astype(np.int32), threshold), f"id {kind}, n int, x long, i int").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    a = first.select("x", F.col("id").alias("p"), F.col("n").alias("np"), F.col("i").alias("ip"), F.col("band").alias("bp"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    b = first.select("x", F.col("id").alias("q"), F.col("n").alias("nq"), F.col("i").alias("iq"), "band")
    least = F.ceil(threshold / (1 + threshold) * (F.col("np") + F.col("nq")) - 1e-9)
    met = a.join(b, ["x", "band"]).where((F.col("bp") < F.col("band")) | (F.col("p") < F.col("q"))).where("p <> q")
    met = met.where((F.col("np") >= threshold * F.col("nq") - 1e-9) & (F.col("nq") >= threshold * F.col("np") - 1e-9) & (F.least(F.col("np") - F.col("ip"), F.col("nq") - F.col("iq")) + SHARED >= least))
    met = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.least(least, F.lit(SHARED)).alias("need"))
    return met.groupBy("a", "b", "need").agg(F.count("*").alias("met")).where("met >= need").select("a", "b")


def _jaccards(threshold: float):
    """Of a bucket's pairs (a, b) and its sets (id, h): those of at least the threshold."""

    def work(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        pairs, sets = pairs.combine_chunks(), sets.combine_chunks()
        words = sets["h"].combine_chunks()
        n = words.value_lengths().to_numpy().astype(np.int64)
        start, known = np.cumsum(n) - n, sets["id"].combine_chunks()
        values, code = np.unique(words.flatten().to_numpy(), return_inverse=True)
        ia, ib = (pc.index_in(pairs[c].combine_chunks(), value_set=known).to_numpy() for c in "ab")
        order, both, mine = np.argsort(ia, kind="stable"), np.zeros(len(ia), np.int64), np.zeros(len(values), bool)
        ends = np.flatnonzero(np.diff(ia[order], append=-1)) + 1
        for low, high in zip(np.concatenate([[0], ends[:-1]]), ends):
            i, them = ia[order[low]], ib[order[low:high]]
            size = n[them]
            at = np.cumsum(size) - size
            mine[code[start[i] : start[i] + n[i]]] = True
            both[order[low:high]] = np.add.reduceat(mine[code[np.repeat(start[them] - at, size) + np.arange(size.sum())]], at, dtype=np.int64)
            mine[code[start[i] : start[i] + n[i]]] = False
        similarity = both / (n[ia] + n[ib] - both)
        keep = pa.array(np.flatnonzero(similarity >= threshold - 1e-12))
        return pa.table({"a": pairs["a"].take(keep), "b": pairs["b"].take(keep), "similarity": pa.array(similarity).take(keep)})

    return work


def near_pairs(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, similarity), a < b: distinct texts whose word sets have a Jaccard similarity of at least the threshold. Keys are
    unique; words are told apart by 64-bit hashes. Equal texts are one row here (see exact_groups).

    Under any one order of words, here rough rarity, sets that share o words share SHARED (or o) of their first
    n - o + SHARED ones, each at a place that leaves room for the rest on both sides; pairs of nearly equal length that meet
    so often are candidates. They are checked in blocks: documents of one least candidate partner travel together, so that a
    large group of near copies sends its words once a TOGETHER documents, not once a pair.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    one = rows.groupBy(tx.content_hash(F.col("t")).alias("_h")).agg(F.min("id").alias("id")).select("id")
    hashed = F.transform(tx.word_set(F.col("t")), lambda w: F.xxhash64(w))
    sets = cut(rows.join(one.hint("shuffle_hash"), "id", "left_semi").select("id", F.array_distinct(hashed).alias("h")).where(F.size("h") > 0))
    pairs = cut(_set_candidates(sets, threshold))
    led = pairs.groupBy("b").agg(F.min("a").alias("g"))
    parts = led.groupBy("g").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    led = cut(led.join(parts, "g").select("b", F.struct("g", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")).alias("g")))
    side = lambda c: led.select(F.col("b").alias(c), F.col("g").alias(f"g{c}"))
    alone = lambda c: F.coalesce(f"g{c}", F.struct(F.col(c).alias("g"), F.lit(0).cast("long").alias("part")))
    units = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.xxhash64(alone("a"), alone("b")).alias("unit"))
    units = cut(units)
    ends = cut(units.select("unit", F.explode(F.array("a", "b")).alias("id")).distinct())
    bucket = F.pmod("unit", F.lit(max(1, ends.count() // BUCKET))).alias("bucket")
    held = ends.select(bucket, "id").distinct().join(sets, "id").select("bucket", "id", "h")
    kind = dict(sets.dtypes)["id"]
    return units.select(bucket, "a", "b").groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_jaccards(threshold), f"a {kind}, b {kind}, similarity double")


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): connected components of similar pairs, named by their smallest id."""
    return connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def cluster_stats(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, pairs, avg_similarity, min_similarity, max_similarity)."""
    got = pairs.join(members.withColumnRenamed("id", "a"), "a")
    return got.groupBy("cluster").agg(F.count("*").alias("pairs"), F.avg("similarity").alias("avg_similarity"), F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"))


def centroids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, centroid): the member of the highest mean similarity to those it is similar to."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "similarity")
    mean = ends.groupBy("id").agg(F.avg("similarity").alias("m")).join(members, "id")
    return mean.groupBy("cluster").agg(F.max_by("id", F.struct(F.round("m", 9), -F.col("id"))).alias("centroid"))


#: From this length on, difflib starts matches only at characters of the second text that aren't popular in it.
AUTOJUNK = 200
#: Pairs of places that are sorted in memory, beyond which difflib itself is asked; runs that become Python's numbers at once.
HITS, STEP = 4_000_000, 4096


def _places(t: str) -> dict[str, list[int]]:
    """Where difflib starts matches in a second text from AUTOJUNK characters on, by character."""
    at = {c: [] for c, n in Counter(t).items() if n <= len(t) // 100 + 1}
    for j, c in enumerate(t):
        if c in at:
            at[c].append(j)
    return at


def _runs(a: str, places: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
    """(-length, i, j) of the runs of characters at which matches start, the longest first, then by places."""
    starts: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        if c in places:
            starts.setdefault(c, []).append(i)
    wide, key = len(a) + 1, [np.empty(0, np.int64)]
    for c, at in starts.items():
        i, j = np.array(at, np.int64)[:, None], np.array(places[c], np.int64)[None, :]
        key.append(((i - j) * wide + i).ravel())
    key = np.sort(np.concatenate(key))
    first = np.flatnonzero(np.diff(key, prepend=-(2**62)) != 1)
    k, i = np.diff(first, append=len(key)), key[first] % wide
    j = i - key[first] // wide
    order = np.lexsort((j, i, -k))
    for x in range(0, len(order), STEP):
        part = order[x : x + STEP]
        yield from zip((-k[part]).tolist(), i[part].tolist(), j[part].tolist())


def _ratio(a: str, b: str, places: dict[str, list[int]] | None = None, least: int = 0) -> float:
    """difflib's ratio of two texts; 0 where fewer than ``least`` characters match. ``places``: those of b, where known.

    difflib takes the longest run of characters at which matches start, the first among equals, grows it, and goes on before
    and behind it, so that every step looks at a whole range again. Here all runs are sorted once; one that
    no longer lies in a free range waits again with what is left of it.
    """
    if len(b) < AUTOJUNK:
        return difflib.SequenceMatcher(None, a, b).ratio()
    at = _places(b) if places is None else places
    seen = Counter(a)
    if sum(seen[c] * len(x) for c, x in at.items()) > HITS:
        return difflib.SequenceMatcher(None, a, b).ratio()
    free, alos, waiting = [(0, len(a), 0, len(b))] if a else [], [0] if a else [], []
    matched, room, runs = 0, min(len(a), len(b)), _runs(a, at)
    following = next(runs, None)
    while following or waiting:
        if waiting and (not following or waiting[0] < following):
            k, i, j = heappop(waiting)
        else:
            (k, i, j), following = following, next(runs, None)
        r = max(bisect_right(alos, i) - 1, 0)
        if r == len(free):
            break
        alo, ahi, blo, bhi = free[r]
        if not (alo <= i and i - k <= ahi and blo <= j and j - k <= bhi):
            while k < -1 and r < len(free) and free[r][0] < i - k:
                s, e = max(i, free[r][0], free[r][2] + i - j), min(i - k, free[r][1], free[r][3] + i - j)
                if s < e:
                    heappush(waiting, (s - e, s, s - i + j))
                r += 1
            continue
        x, y = i - k, j - k
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while x < ahi and y < bhi and a[x] == b[y]:
            x, y = x + 1, y + 1
        free[r : r + 1] = [f for f in ((alo, i, blo, j), (x, ahi, y, bhi)) if f[0] < f[1] and f[2] < f[3]]
        alos[r : r + 1] = [f[0] for f in ((alo, i, blo, j), (x, ahi, y, bhi)) if f[0] < f[1] and f[2] < f[3]]
        matched += x - i
        room += min(i - alo, j - blo) + min(ahi - x, bhi - y) - min(ahi - alo, bhi - blo)
        if matched + room < least:
            return 0.0
    # a common beginning needs no such place
    if free and free[0][0] == free[0][2] == 0:
        matched += next((n for n, (x, y) in enumerate(zip(a[: free[0][1]], b[: free[0][3]])) if x != y), min(free[0][1], free[0][3]))
    return 0.0 if matched < least else 2.0 * matched / (len(a) + len(b))


def sequence_ratio(pairs: DataFrame, left: str, right: str, into: str = "ratio") -> DataFrame:
    """difflib's ratio of the lower-cased, stripped texts, in Arrow batches. It is not symmetric: left is the first text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[into] = [_ratio(a.lower().strip(), b.lower().strip()) for a, b in zip(pdf[left].fillna(""), pdf[right].fillna(""))]
            yield pdf

    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + f", {into} double"
    return pairs.mapInPandas(work, schema)


def jaro_winkler(a: str, b: str, scale: float = 0.1, most: int = 4) -> float:
    """Matches within half the longer length; up to four common first letters lift the score."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [x for x, u in zip(b, used) if u]
    swaps, m = sum(x != y for x, y in zip(left, right)) // 2, len(left)
    score = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return score + min(prefix, most) * scale * (1 - score)


def leader_groups(docs: DataFrame, block: list[str], threshold: float = 0.85, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, leader): in key order each text joins the first leader of its block with at least the threshold, or leads.
    Order-dependent, so a block is one task: choose block columns that bound its size."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        leaders, out = [], []
        for k, t in zip(pdf[key], pdf[text].fillna("")):
            t, found = t.lower().strip(), None
            if len(t) >= least:
                for lk, lt in leaders:
                    m = difflib.SequenceMatcher(None, lt, t)
                    if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
                        found = lk
                        break
                if found is None:
                    leaders.append((k, t))
            out.append((k, k if found is None else found))
        return pd.DataFrame(out, columns=[key, "leader"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text, *block).groupBy(*block).applyInPandas(group, f"{key} {kind}, leader {kind}")


def normalised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, t): texts as difflib compares them, lower-cased and stripped by Python's rules; null is empty."""
    kind = dict(docs.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "t": [t.lower().strip() for t in pdf[text].fillna("")]})

    return docs.select(key, text).mapInPandas(work, f"`{key}` {kind}, t string")


# Lengths of q-grams and the least counters that they are hashed to (shared counters only raise an overlap), from three
# characters on as many as the longest text asks for; texts and characters of a block.
_GRAMS = ((1, 64), (2, 512), (4, 1024))
TEXTS, CHARS = 2000, 4_000_000
#: Characters of a window, and of the grams by the least hash of which it is known; bits of a hash that give way to a text's number.
SPAN, GRAM, NUMBER = 10, 8, 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character of all texts: its code, its text's number, how many its text has from there on."""
    size = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(row))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), row, left


def _bag(texts: list[str], q: int, least: int, longest: int) -> np.ndarray:
    """A row of counters a text, of its q-grams."""
    code, row, left = _codes(texts)
    m = least if q < 3 else max(least, 1 << longest.bit_length())
    gram = np.zeros(max(len(code) - q + 1, 0), np.uint64)
    for i in range(q):
        gram = (gram + code[i : i + len(gram)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    whole = left[: len(gram)] >= q
    slot = ((gram >> np.uint64(33)) & np.uint64(m - 1)).astype(np.int64)
    return np.bincount((row[: len(gram)] * m + slot)[whole], minlength=len(texts) * m).astype(np.int32).reshape(len(texts), m)


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, text, times), in order of values: what the windows of SPAN characters of each text are known by."""
    code, row, left = _codes(texts)
    gram, q = code + np.uint64(1), 1
    while q < GRAM:
        gram = gram[:-q] * np.uint64(0x9E3779B97F4A7C15) + gram[q:]
        gram, q = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), 2 * q
    n = max(len(code) - SPAN + 1, 0)
    known = gram[:n]
    for i in range(1, SPAN - GRAM + 1):
        known = np.minimum(known, gram[i : i + n])
    whole = left[:n] >= SPAN
    one, times = np.unique((known[whole] >> np.uint64(NUMBER) << np.uint64(NUMBER)) | row[:n][whole].astype(np.uint64), return_counts=True)
    return one >> np.uint64(NUMBER), (one & np.uint64((1 << NUMBER) - 1)).astype(np.int64), times


def _shared_windows(mine: tuple, theirs: tuple, n: int, m: int):
    """A function of a text of ``mine`` (n texts): how many windows at most it can share with each of ``theirs`` (m texts)."""
    value, row, times = mine
    other, orow, otimes = theirs
    first = np.flatnonzero(np.concatenate([[True], other[1:] != other[:-1]])) if len(other) else np.empty(0, np.int64)
    ends, known = np.append(first[1:], len(other)), other[first]
    at = np.searchsorted(known, value)
    met = np.flatnonzero((known[np.minimum(at, len(known) - 1)] == value)) if len(known) else np.empty(0, np.int64)
    met = met[np.argsort(row[met], kind="stable")]
    low, count, times = first[at[met]], ends[at[met]] - first[at[met]], times[met]
    bounds = np.searchsorted(row[met], np.arange(n + 1))

    def shared(p: int) -> np.ndarray:
        s = slice(bounds[p], bounds[p + 1])
        c = count[s]
        place = np.repeat(low[s] - np.cumsum(c) + c, c) + np.arange(c.sum())
        return np.bincount(orow[place], np.minimum(np.repeat(times[s], c), otimes[place]), minlength=m)

    return shared


def _unpopular(t: str) -> int:
    """How many places of a second text difflib starts matches at; no bound where it is short."""
    return sum(n for n in Counter(t).values() if n <= len(t) // 100 + 1) if len(t) >= AUTOJUNK else 2**31


def _masks(t: str) -> dict[str, int]:
    """Of each character, its places as bits."""
    at: dict[str, bytearray] = {}
    for i, c in enumerate(t):
        at.setdefault(c, bytearray(len(t) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    return {c: int.from_bytes(x, "little") for c, x in at.items()}


def _lcs(masks: dict[str, int], size: int, t: str) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyrö); no matching of difflib is longer."""
    every = (1 << size) - 1
    v = every
    for c in t:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & every
    return size - v.bit_count()


def ratio_pairs(rows: DataFrame, threshold: float = 0.85, block: int = TEXTS) -> DataFrame:
    """(a, b, ratio), a < b: rows of (id, t) whose difflib ratio, a's text first, is at least the threshold.

    Filters that lose no pair: of two lengths the larger is at most (2 - threshold) / threshold times the smaller, so
    pairs stand in one length band or in neighbours; M characters matched in k blocks leave M - (q - 1) k q-grams in common,
    and as many windows of q characters, which equal stretches know by equal values; those are looked up by value, so that a
    pair with none in common costs next to nothing. M is no more than the longest common subsequence. Blocks are parted by a character that isn't matched, so
    k <= la + lb - 2 M + 1; and each but a common beginning has a place of the second text that isn't popular in it (see
    AUTOJUNK). Bands are dealt in blocks of about ``block`` texts, fewer long ones, and a task compares two blocks. Empty
    texts have no pairs.
    """
    kind = dict(rows.dtypes)["id"]
    step = math.log((2 - threshold) / threshold) * (1 + 1e-9)
    banded = rows.where("t <> ''").withColumn("band", F.floor(F.log(F.length("t").cast("double")) / step))
    parts = banded.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("t")) / CHARS)).cast("int").alias("parts"))
    placed = banded.join(F.broadcast(parts), "band").select("id", "t", "band", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    blocks = parts.select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    left, right = blocks.select(F.col("band").alias("b1"), F.col("part").alias("p1")), blocks.select(F.col("band").alias("b2"), F.col("part").alias("p2"))
    near = left.withColumn("b2", F.explode(F.array(F.col("b1"), F.col("b1") + 1))).join(right, "b2").where("b2 > b1 or p2 >= p1")
    sides = near.select("b1", "p1", "b2", "p2", F.explode(F.when((F.col("b1") == F.col("b2")) & (F.col("p1") == F.col("p2")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumns({"band": F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b2")), "part": F.when(F.col("side") == 0, F.col("p1")).otherwise(F.col("p2"))})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        # one block with itself, or the first with the second; texts by length
        pdf = pdf.iloc[np.argsort(pdf["t"].map(len).to_numpy(), kind="stable")]
        ids, texts, side, out = pdf["id"].tolist(), pdf["t"].tolist(), pdf["side"].to_numpy(), []
        size, alone = np.array([len(t) for t in texts], np.int64), not side.any()
        first = np.flatnonzero(side == 0)
        other = first if alone else np.flatnonzero(side == 1)
        ours, others = [texts[i] for i in first], [texts[i] for i in other]
        windows = _windows(ours)
        shared = _shared_windows(windows, windows if alone else _windows(others), len(ours), len(others))
        bags = cache(lambda q, m: (_bag(ours, q, m, int(size.max())), None if alone else _bag(others, q, m, int(size.max()))))
        places, counts = lru_cache(256)(lambda i: _places(texts[i])), lru_cache(256)(lambda i: Counter(texts[i]))
        rare, rank, reach = np.array([_unpopular(t) for t in texts], np.int64), np.argsort(np.argsort(pdf["id"].to_numpy())), math.exp(step)
        for p, i in enumerate(first):
            near = np.arange(p + 1 if alone else np.searchsorted(size[other], size[i] / reach), np.searchsorted(size[other], size[i] * reach, "right"))
            them = other[near]
            least = np.ceil(threshold * (size[i] + size[them]) / 2 - 1e-6).astype(np.int64)
            parted = np.minimum(np.where(rank[them] > rank[i], rare[them], rare[i]), size[i] + size[them] - 2 * least) + 1
            common = shared(p)
            ok = (np.minimum(size[i], size[them]) >= least) & (common[near] >= least - (SPAN - 1) * parted)
            for q, m in _GRAMS:
                near, least, parted = near[ok], least[ok], parted[ok]
                if not len(near):
                    break
                own, bag = bags(q, m)
                ok = np.minimum((own if alone else bag)[near], own[p]).sum(1) >= least - (q - 1) * parted
            if not len(near):
                continue
            masks = None
            for at, m in zip(near[ok], least[ok]):
                j = other[at]
                a, b = (i, j) if ids[i] < ids[j] else (j, i)
                # a block starts at a place of the second text that isn't popular, and the first has that character too
                if len(texts[b]) >= AUTOJUNK and common[at] < m - (SPAN - 1) * (1 + sum(min(len(x), counts(a)[c]) for c, x in places(b).items())):
                    continue
                if len(texts[b]) < AUTOJUNK:
                    masks = masks or _masks(texts[i])
                    ratio = 0.0 if _lcs(masks, len(texts[i]), texts[j]) < m else _ratio(texts[a], texts[b])
                else:
                    ratio = _ratio(texts[a], texts[b], places(b), m)
                if ratio >= threshold:
                    out.append((ids[a], ids[b], ratio))
        return pd.DataFrame(out, columns=["a", "b", "ratio"])

    dealt = placed.join(sides, ["band", "part"]).select("b1", "p1", "b2", "p2", "side", "id", "t")
    return dealt.groupBy("b1", "p1", "b2", "p2").applyInPandas(compare, f"a {kind}, b {kind}, ratio double")


def fuzzy_pairs(docs: DataFrame, threshold: float = 0.85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, ratio), a < b: distinct texts of at least the threshold by difflib's ratio, and near_pairs whatever theirs.
    Texts that are equal lower-cased and stripped are one row here."""
    texts = docs.select(key, text)
    sides = lambda k, t: texts.select(F.col(key).alias(k), F.col(text).alias(t))
    near = near_pairs(texts, key=key, text=text).join(sides("a", "ta"), "a").join(sides("b", "tb"), "b")
    near = sequence_ratio(near.select("a", "b", "ta", "tb"), "ta", "tb").select("a", "b", "ratio")
    rows = normalised(texts, key, text).groupBy("t").agg(F.min(key).alias("id"))
    return near.unionByName(ratio_pairs(rows, threshold)).dropDuplicates(["a", "b"])


def greedy_rounds(pairs: DataFrame) -> DataFrame:
    """(b, l) of pairs (a, b), a < b: the first leader that b follows. A row without an earlier undecided one leads, and
    those that it pairs with later follow; rounds go on until no undecided pair is left."""
    left, follows = pairs, pairs.select(F.col("b").alias("f")).limit(0)
    while not left.isEmpty():
        leads = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = left.join(leads, "a").select(F.col("b").alias("f")).distinct()
        follows = cut(follows.unionByName(new))
        left = cut(left.join(leads, "a", "left_anti").join(follows.select(F.col("f").alias("a")), "a", "left_anti").join(follows.select(F.col("f").alias("b")), "b", "left_anti").select("a", "b"))
    return pairs.join(follows.select(F.col("f").alias("a")), "a", "left_anti").groupBy("b").agg(F.min("a").alias("l"))


def greedy_leaders(docs: DataFrame, threshold: float = 0.85, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, leader) of leader_groups with the whole table as one block, for unique keys, without one task for all.

    Equal texts have one leader, so one row stands for them (see greedy_rounds for the rest).
    """
    texts = cut(normalised(docs, key, text))
    long = texts.where(F.length("t") >= least)
    rows = long.groupBy("t").agg(F.min(key).alias("id"))
    pairs = cut(ratio_pairs(rows, threshold).select("a", "b"))
    led = greedy_rounds(pairs)
    by_text = rows.join(led, rows["id"] == led["b"], "left").select("t", F.coalesce("l", "id").alias("leader"))
    return long.join(by_text, "t").select(key, "leader").unionByName(texts.where(F.length("t") < least).select(key, F.col(key).alias("leader")))


def merged(rows: DataFrame, group: str, strategy: str, key: str = "doc_id", content: str = "content", confidence: str = "confidence") -> DataFrame:
    """(group, content, confidence, members): keep_best (longest, then surest) or concat of distinct contents in key order."""
    if strategy == "keep_best":
        text = F.max_by(content, F.struct(F.length(content), F.col(confidence), -F.col(key)))
    else:
        text = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(key, content))), lambda x: x[content])), "; ")
    return rows.groupBy(group).agg(text.alias("content"), F.least(F.lit(1.0), F.avg(confidence) + 0.1 * F.count("*")).alias("confidence"), F.count("*").alias("members"))


# A negative form and the positive form that it denies.
NEGATIONS = (
    ("is not", "is"), ("isn't", "is"), ("are not", "are"), ("aren't", "are"), ("was not", "was"), ("wasn't", "was"), ("were not", "were"),
    ("weren't", "were"), ("does not", "does"), ("doesn't", "does"), ("do not", "do"), ("don't", "do"), ("cannot", "can"), ("can't", "can"), ("never", "always"), ("no longer", "still"),
)


def contradicts(a: Column, b: Column, pairs=NEGATIONS) -> Column:
    """One text has a negative form, the other its positive form and not the negative one."""
    out = F.lit(False)
    for neg, pos in pairs:
        na, nb, pa, pb = (F.contains(F.lower(t), F.lit(x)) for x in (neg, pos) for t in (a, b))
        out = out | (na & pb & ~nb) | (nb & pa & ~na)
    return out


def value_conflict(a: Column, b: Column, pattern: str = r"(?i)([a-z ]+?) is (\w+)") -> Column:
    """Both texts state a value for the same key, and the values differ."""
    part = lambda t, g: F.lower(F.regexp_extract(t, pattern, g))
    return (part(a, 1) != "") & (part(a, 1) == part(b, 1)) & (part(a, 2) != part(b, 2))


def incremental_decision(similarity: Column, conflict: Column) -> Column:
    """skip from .95; review a conflict from .7; add_and_link from .7; else add."""
    return F.when(similarity >= 0.95, "skip").when((similarity >= 0.7) & conflict, "review").when(similarity >= 0.7, "add_and_link").otherwise("add")


def numbered_chunks(rows: DataFrame, size: int, by: list[str], order: str) -> DataFrame:
    """Batches of ``size`` rows per key, from 0."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size))
