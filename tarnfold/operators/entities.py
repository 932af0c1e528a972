"""Entity resolution by name: Jaro-Winkler links without all pairs, components, aliases and rewired edges."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.components import connected_components
from tarnfold.session import cut

SCALE, PREFIX = 0.1, 4
#: Keys a name may have, common letters that a key may hold, letters whose frequency is looked up, pairs compared at once.
KEYS, MOST_LETTERS, RANKED, STEP = 64, 4, 100_000, 4096
#: Names of a key that a task compares with each other, rows of keys that it takes, common letters (see needed) from which on
#: keys go by lengths.
LIST, BUCKET, CLOSE = 2048, 10_000, 1.8


def jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Of paired strings, all pairs at a time: letters match within half the longer length, first come first; up to four
    common first letters lift the score."""
    out = np.zeros(len(left))
    for a in range(0, len(left), STEP):
        out[a : a + STEP] = _paired(left[a : a + STEP], right[a : a + STEP])
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(1, size.max(initial=0))), np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = [ord(c) for c in t]
    return out, size


def _paired(left: list[str], right: list[str]) -> np.ndarray:
    a, na = _codes(left)
    b, nb = _codes(right)
    place = np.arange(b.shape[1])
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)[:, None]
    inside = place[None, :] < nb[:, None]
    used, hit = np.zeros(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fits = (b == a[:, i : i + 1]) & ~used & inside & (np.abs(place[None, :] - i) <= reach) & (i < na)[:, None]
        first = fits.argmax(axis=1)
        found = fits[np.arange(len(b)), first]
        used[np.flatnonzero(found), first[found]] = True
        hit[:, i] = found
    m = hit.sum(axis=1)
    ordered = lambda x, mask: np.take_along_axis(x, np.argsort(~mask, axis=1, kind="stable"), axis=1)
    k = min(a.shape[1], b.shape[1])
    same_order = (ordered(a, hit)[:, :k] == ordered(b, used)[:, :k]) | (np.arange(k)[None, :] >= m[:, None])
    swaps = (~same_order).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(m > 0, (m / na + m / nb + (m - swaps) / m) / 3, 0.0)
    head = np.minimum(np.minimum(na, nb), PREFIX)
    equal = np.zeros((len(a), PREFIX), bool)
    w = min(PREFIX, k)
    equal[:, :w] = a[:, :w] == b[:, :w]
    common = np.minimum(np.cumprod(equal, axis=1).sum(axis=1), head)
    return np.where((na == nb) & (na == 0), 1.0, score + common * SCALE * (1 - score))


def needed(threshold: float) -> float:
    """c, where a score of at least ``threshold`` needs m / |a| + m / |b| >= c of m common letters: Jaro's part of it with four
    common first letters and no swaps."""
    jaro = (threshold - PREFIX * SCALE) / (1 - PREFIX * SCALE)
    return 3 * jaro - 1


def _letters(text: str) -> list[tuple[str, int]]:
    seen: Counter[str] = Counter()
    out = []
    for c in text:
        seen[c] += 1
        out.append((c, seen[c]))
    return out


def _common(c: float, n: int, m: int) -> int:
    """Letters that similar names of n and m letters have in common at least."""
    return math.ceil(c * n * m / (n + m) - 1e-9)


def _by_lengths(c: float, lengths: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Of each length: (other length, common letters, letters a key) of those that it can be similar to."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for n in lengths:
        for m in lengths:
            o = _common(c, n, m)
            if 0 < o <= min(n, m):
                slack = max(n, m) - o
                out.setdefault(n, []).append((m, o, max(k for k in range(1, o + 1) if k == 1 or math.comb(slack + k, k) <= KEYS)))
    return out


def _close_names(rows: DataFrame, threshold: float, rank: dict[str, int]) -> DataFrame:
    """similar_names for high thresholds. A key holds as many letters as the two lengths allow (of equal lengths often all of
    them), so that few names share one. Names of a key are compared in a task, long lists in parts of LIST that meet pairwise."""
    c, jaro = needed(threshold), (threshold - PREFIX * SCALE) / (1 - PREFIX * SCALE)
    lengths = [r[0] for r in rows.select(F.length("name")).distinct().collect() if r[0]]  # bounded by the longest name
    plan = _by_lengths(c, lengths)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b["name"].to_pylist()):
                n = len(text)
                letters = sorted(_letters(text), key=lambda x: (-rank.get(x[0], 1), x[0], -x[1]))
                keys = {f"{min(n, m)},{max(n, m)}:" + "".join(f"{ch}{k}," for ch, k in part) for m, o, size in plan.get(n, ()) for part in combinations(letters[: n - o + size], size)}
                at += [i] * len(keys)
                found += sorted(keys)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"].take(take), b["by"].take(take), b["name"].take(take), pa.array(found, pa.string())], names=["id", "by", "name", "key"])

    kind = dict(rows.dtypes)["by"]
    keys = rows.where("by is not null").mapInArrow(keyed, f"id long, by {kind}, name string, key string")
    keys = cut(keys.select("id", "name", F.xxhash64("by", "key").alias("list"), "by"))
    lists = keys.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").select("list", F.ceil(F.col("n") / LIST).cast("int").alias("parts"))
    dealt = keys.join(lists, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", "by", "name", "part", F.xxhash64("list", F.least("part", "other"), F.greatest("part", "other")).alias("unit"))
    buckets = max(1, keys.count() // BUCKET)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        unit, ids, part, names = (table[x].to_numpy() for x in ("unit", "id", "part", "name"))
        kinds = table["by"].combine_chunks().dictionary_encode().indices.to_numpy()
        code, size = _codes(names.tolist())
        swaps = np.floor(3 * size * (1 - jaro) + 1e-9)
        whole = np.array([_common(c, int(n), int(n)) == n if n else False for n in size])
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        left, right = [], []
        for low, high in zip(starts, np.append(starts[1:], len(unit))):
            first = part[low:high].min() if high > low else 0
            mixed = part[low:high].max() > first
            for i in range(low, high):
                if mixed and part[i] != first:
                    continue
                them = low + np.flatnonzero(part[low:high] != first) if mixed else np.arange(i + 1, high)
                them = them[(kinds[them] == kinds[i]) & (ids[them] != ids[i])]
                # of equal lengths where all letters have to match, places that differ are swaps
                differ = (code[them] != code[i]).sum(axis=1)
                them = them[~(whole[i] & (size[them] == size[i]) & (differ > 2 * swaps[i] + 1))]
                left.append(np.full(len(them), i))
                right.append(them)
        i, j = (np.concatenate(x + [np.empty(0, int)]).astype(int) for x in (left, right))
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        score = jaro_winkler(names[i].tolist(), names[j].tolist())
        keep = score >= threshold - 1e-12
        return pa.table({"a": ids[i[keep]], "b": ids[j[keep]], "similarity": score[keep]})

    found = met.groupBy(F.pmod("unit", F.lit(buckets))).applyInArrow(compare, "a long, b long, similarity double")
    return found.dropDuplicates(["a", "b"])


def similar_names(names: DataFrame, threshold: float = 0.92, by: str = "type", name: str = "name", key: str = "id") -> DataFrame:
    """(a, b, similarity): pairs of ids, a < b, of one ``by`` whose names' Jaro-Winkler is at least ``threshold`` (above 0.8),
    none left out. Names are taken as they are; ids are integers, a name each; null names take no part.

    Similar names share letters (counted with repeats): at least o of them, by ``needed``. So, in one order of letters, they
    share any l of the first |name| - o + l; keys are combinations of l such letters, rare ones first, with l as large as
    the number of keys allows. Names too short for l have keys of one letter, and so have those that could match them.
    """
    c = needed(threshold)
    if c <= 1:
        raise ValueError("a threshold of at most 0.8 rules nothing out")
    rows = names.where(F.col(name).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(by).alias("by"), F.col(name).alias("name"))
    spelt = F.filter(F.split("name", ""), lambda x: x != "")
    counts = rows.select(F.explode(spelt).alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(RANKED).collect()
    rank = {r["c"]: -r["n"] for r in counts}  # letters beyond these are rarer: they come first, in their own order
    if c >= CLOSE:
        return _close_names(rows, threshold, rank)
    longest = rows.agg(F.max(F.length("name"))).first()[0] or 0
    common = lambda n: math.ceil((c - 1) * n - 1e-9)
    slack = max((n - common(n) for n in range(1, longest + 1)), default=0)
    size = max(k for k in range(1, MOST_LETTERS + 1) if k == 1 or math.comb(slack + k, k) <= KEYS)
    short = max((n for n in range(1, longest + 1) if common(n) < size), default=0)
    reach = int(short / (c - 1) + 1e-9)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b["name"].to_pylist()):
                n = len(text)
                # the k-th of a letter is rarer than the first: later ones of frequent letters come late all the same
                letters = sorted(_letters(text), key=lambda x: (-rank.get(x[0], 1), x[0], -x[1]))
                keys = set()
                if n and common(n) >= size:
                    keys |= {f"{size}" + "".join(f"{ch}{k}," for ch, k in part) for part in combinations(letters[: n - common(n) + size], size)}
                if n and n <= reach:
                    keys |= {f"1{ch}{k}," for ch, k in letters[: n - common(n) + 1]}
                at += [i] * len(keys)
                found += sorted(keys)
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at, pa.int64())), b["by"].take(pa.array(at, pa.int64())), b["name"].take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "by", "name", "key"])

    kind = dict(rows.dtypes)["by"]
    keys = cut(rows.mapInArrow(keyed, f"id long, by {kind}, name string, key string"))
    a, b = (keys.select("by", "key", F.col("id").alias(x), F.col("name").alias(f"n{x}")) for x in "ab")
    fits = (F.least(F.length("na"), F.length("nb")) * (1 / F.length("na") + 1 / F.length("nb"))) >= c - 1e-9
    pairs = a.join(b, ["by", "key"]).where(F.col("a") < F.col("b")).where(fits).select("a", "b", "na", "nb").distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            score = jaro_winkler(x["na"].to_pylist(), x["nb"].to_pylist())
            keep = pa.array(np.flatnonzero(score >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([x["a"].take(keep), x["b"].take(keep), pa.array(score).take(keep)], names=["a", "b", "similarity"])

    return pairs.mapInArrow(verified, "a long, b long, similarity double")


def resolve(entities: DataFrame, threshold: float = 0.92, by: str = "type", name: str = "name", key: str = "id") -> DataFrame:
    """(key, entity): every row with the smallest id of those it is the same as: equal names (case and outer spaces aside) and
    similar ones, also by way of others. Equal names are one before any comparison, so copies cost nothing; rows without a
    name are entities of their own."""
    rows = entities.select(F.col(key).cast("long").alias("id"), F.col(by).alias("by"), F.trim(F.lower(F.col(name))).alias("name"))
    one = cut(rows.where("name is not null").groupBy("by", "name").agg(F.min("id").alias("first")))
    links = similar_names(one.select(F.col("first").alias("id"), "by", "name"), threshold, "by")
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    led = one.join(parts, F.col("first") == F.col("node"), "left").select("by", "name", F.coalesce("component", "first").alias("entity"))
    return rows.join(led, ["by", "name"], "left").select(F.col("id").alias(key), F.coalesce("entity", "id").alias("entity"))


def aliases(entities: DataFrame, resolved: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """(entity, alias, mentions): the spellings of each entity, a row each."""
    return entities.join(resolved, key).where(F.col(name).isNotNull()).groupBy("entity", F.col(name).alias("alias")).agg(F.count("*").alias("mentions"))
