"""Exact dedup by a cuckoo-filter index of live digests.

Digests are dealt to shards by hash. A shard's index is a cuckoo filter, buckets of four 16-bit fingerprints, and beside
each cell the whole digest that is stored there (the bucketed content). A digest that meets no equal fingerprint is new
for certain; a hit is verified against the stored digest of its cell. Deletion clears the cell. Where an insertion finds no
room after many evictions, the filter doubles and is filled again from the stored digests. As a table, an index is a row a
live digest with its cell, so it is loaded without hashing anything again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.text import mix, tidy
from tarnfold.session import cut

#: Digests that one shard is meant to hold, and that a map task holds before it hands them on.
SHARD_ROWS, LOCAL_ROWS = 500_000, 200_000
SLOTS, KICKS, FULL = 4, 500, 0.9
#: Fewer rows a task are not worth a file of their own.
FILE_ROWS = 50_000
#: Copies of one row that come back from one row at a time.
COPIES = 10_000
NONE = np.iinfo(np.int64).max
INDEX = "shard int, digest binary, keep_id long, group_size long, bucket int, slot int, buckets int, shards int"


class CuckooIndex:
    """Live digests (rows of four 64-bit words) with the smallest id and the number of rows of each."""

    def __init__(self, capacity: int = 64):
        self.keys, self.first, self.size = np.empty((0, 4), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.n, self.free, self.resizes = 0, [], 0
        self._clear(1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * FULL))))))

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.held = np.full((buckets, SLOTS), -1, np.int32)

    def __len__(self) -> int:
        return self.n - len(self.free)

    @property
    def alive(self) -> np.ndarray:
        """Numbers of the live keys."""
        return np.sort(self.held[self.held >= 0])

    def _print(self, digests: np.ndarray) -> np.ndarray:
        return np.maximum(digests[:, 1].astype(np.uint16), 1)

    def _other(self, bucket, prints):
        """The other bucket of a fingerprint: its own inverse."""
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = self._print(digests)
        one = (digests[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, one, self._other(one, prints)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Number of each digest's key, -1 where it isn't live. Only cells of an equal fingerprint are compared whole."""
        prints, one, two = self._places(digests)
        out = np.full(len(digests), -1, np.int64)
        for bucket in (one, two):
            for s in range(SLOTS):
                hit = np.flatnonzero((out < 0) & (self.prints[bucket, s] == prints))
                if len(hit):
                    k = self.held[bucket[hit], s]
                    same = (self.keys[k] == digests[hit]).all(axis=1)
                    out[hit[same]] = k[same]
        return out

    def insert(self, digests: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Distinct digests that are not live."""
        if self.n + len(digests) > len(self.keys):
            more = max(64, len(self.keys), len(digests))
            self.keys = np.concatenate([self.keys, np.zeros((more, 4), np.uint64)])
            self.first, self.size = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (self.first, self.size))
        reused = [self.free.pop() for _ in range(min(len(self.free), len(digests)))]
        numbers = np.array(reused + list(range(self.n, self.n + len(digests) - len(reused))), np.int64)
        self.n += len(digests) - len(reused)
        self.keys[numbers], self.first[numbers], self.size[numbers] = digests, first, size
        self._settle(numbers)

    def _settle(self, numbers: np.ndarray) -> None:
        """Gives stored keys their cells; overflow doubles the filter and deals all stored keys again."""
        alive = None
        while len(self) > FULL * SLOTS * self.buckets or not self._place(numbers):
            if alive is None:
                alive = np.setdiff1d(np.arange(self.n), np.array(self.free, np.int64))
            self._clear(self.buckets * 2)
            self.resizes += 1
            numbers = alive

    def _place(self, numbers: np.ndarray) -> bool:
        prints, one, two = self._places(self.keys[numbers])
        left = np.arange(len(numbers))
        for bucket in (one, two):
            for s in range(SLOTS):
                open_ = left[self.held[bucket[left], s] < 0]
                _, at = np.unique(bucket[open_], return_index=True)  # one key a cell
                now = open_[at]
                self.held[bucket[now], s], self.prints[bucket[now], s] = numbers[now], prints[now]
                left = np.setdiff1d(left, now)
        return all(self._evict(int(numbers[i]), int(two[i]), int(prints[i])) for i in left)

    def _evict(self, key: int, bucket: int, fingerprint: int) -> bool:
        for kick in range(KICKS):
            room = np.flatnonzero(self.held[bucket] < 0)
            s = int(room[0]) if len(room) else kick % SLOTS
            out, out_print = int(self.held[bucket, s]), int(self.prints[bucket, s])
            self.held[bucket, s], self.prints[bucket, s] = key, fingerprint
            if out < 0:
                return True
            key, fingerprint = out, out_print
            bucket = int(self._other(np.array([bucket]), np.array([fingerprint]))[0])
        return False

    def delete(self, digests: np.ndarray) -> None:
        """Distinct live digests: their cells are free again."""
        gone = self.find(digests)
        cells = np.isin(self.held, gone[gone >= 0]) & (self.held >= 0)
        self.held[cells], self.prints[cells] = -1, 0
        self.free += gone[gone >= 0].tolist()

    def add(self, digests: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Rows with any digests, repeated ones too: known digests get smaller ids and larger sizes, new ones go in."""
        if not len(digests):
            return
        order = np.lexsort(digests.T[::-1])
        d = digests[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)])
        starts = np.flatnonzero(new)
        d, low, many = d[starts], np.minimum.reduceat(first[order], starts), np.add.reduceat(size[order], starts)
        at = self.find(d)
        known = at >= 0
        self.first[at[known]] = np.minimum(self.first[at[known]], low[known])
        self.size[at[known]] += many[known]
        self.insert(d[~known], low[~known], many[~known])

    def table(self, shard: int, shards: int) -> pa.Table:
        bucket, slot = np.nonzero(self.held >= 0)
        k = self.held[bucket, slot]
        n = len(k)
        ints = lambda v: pa.array(np.asarray(v).astype(np.int32))
        cols = [ints(np.full(n, shard)), _binary(self.keys[k]), _ids(self.first[k]), pa.array(self.size[k]), ints(bucket), ints(slot), ints(np.full(n, self.buckets)), ints(np.full(n, shards))]
        return pa.table(cols, names=["shard", "digest", "keep_id", "group_size", "bucket", "slot", "buckets", "shards"])

    @classmethod
    def loaded(cls, rows: pa.Table) -> CuckooIndex:
        """From a shard's rows as ``table`` gave them: fingerprints go straight to their cells."""
        out = cls()
        if rows.num_rows:
            out._clear(rows["buckets"][0].as_py())
            out.keys, out.first, out.size = _words(rows["digest"]), _filled(rows["keep_id"]), rows["group_size"].to_numpy().copy()
            out.n = len(out.keys)
            cell = rows["bucket"].to_numpy(), rows["slot"].to_numpy()
            out.held[cell], out.prints[cell] = np.arange(out.n), out._print(out.keys)
        return out


def _words(column) -> np.ndarray:
    """32-byte values as rows of four 64-bit words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fixed = column.cast(pa.binary(32))
    return np.frombuffer(fixed.buffers()[1], np.uint64, len(fixed) * 4, fixed.offset * 32).reshape(-1, 4).copy() if len(fixed) else np.empty((0, 4), np.uint64)


def _binary(words: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(words), [None, pa.py_buffer(np.ascontiguousarray(words).tobytes())]).cast(pa.binary())


def _filled(ids) -> np.ndarray:
    return ids.fill_null(int(NONE)).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(ids, pa.Array) else ids.fill_null(int(NONE)).to_numpy().astype(np.int64)


def _ids(first: np.ndarray) -> pa.Array:
    return pa.array(first, pa.int64(), mask=first == NONE)


def normalised(text: str | Column) -> Column:
    """Every run of white space (0x20, 0x09-0x0D) as one space; null as empty. Single spaces stand as they are."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, copies): sha-256 of each normalised text; rows that agree in both are counted before the shuffle."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"))
    return rows.groupBy("id", "digest").agg(F.count("*").alias("copies"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Cut to few files where ``rows`` are few: every file costs the executor a child process."""
    return cut(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))))


def _shard(digest: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def build(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """INDEX rows of (id, digest, copies).

    A map task folds its rows through an index of its own, at most LOCAL_ROWS digests at a time, so that a text with
    however many copies is a row a task; a shard's index then takes these in. Null ids are larger than all others, and so is
    2^63 - 1, which is taken for null. ``shards`` is by default what holds SHARD_ROWS rows each.
    """
    if shards is None:
        shards = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SHARD_ROWS))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = CuckooIndex()
        given = lambda: pa.RecordBatch.from_arrays([_binary(found.keys[k := found.alive]), _ids(found.first[k]), pa.array(found.size[k])], names=["digest", "first", "n"])
        for b in batches:
            found.add(_words(b["digest"]), _filled(b["id"]), b["copies"].to_numpy())
            if len(found) >= LOCAL_ROWS:
                yield given()
                found = CuckooIndex()
        if len(found):
            yield given()
        tidy()

    def shard(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for b in batches:
            index.add(_words(b["digest"]), _filled(b["first"]), b["n"].to_numpy())
        yield from index.table(key[0].as_py(), shards).to_batches()
        tidy()

    parts = rows.select("id", "digest", "copies").mapInArrow(local, "digest binary, first long, n long")
    return parts.withColumn("shard", _shard("digest", shards)).groupBy("shard").applyInArrow(shard, INDEX)


def update(index: DataFrame, held: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The index and its members (id, digest, copies) after rows went in and out.

    Members are counted by signed copies; digests without a row left leave the filter, new ones enter it, and a text whose
    kept row went gets the next smallest id. Only shards of touched digests change. Removing rows that aren't there does
    nothing.
    """
    signed = lambda df, sign: df.select("id", "digest", (F.col("copies") * sign).alias("copies"))
    changes = [signed(df, sign) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    if not changes:
        return index, held
    change = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
    after = cut(held.select("id", "digest", "copies").unionByName(change).groupBy("id", "digest").agg(F.sum("copies").alias("copies")).where("copies > 0"))
    touched = change.select("digest").distinct()
    live = touched.join(after, "digest", "left").groupBy("digest").agg(F.min("id").alias("first"), F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))
    shards = index.agg(F.max("shards")).first()[0]
    if shards is None:  # nothing was live
        return build(after), after
    return _apply(index, live.withColumn("shard", _shard("digest", shards)), shards), after


def _apply(index: DataFrame, live: DataFrame, shards: int) -> DataFrame:
    def fold(key: tuple[pa.Scalar, ...], stored: pa.Table, changes: pa.Table) -> pa.Table:
        found = CuckooIndex.loaded(stored)
        digests, first, n = _words(changes["digest"]), _filled(changes["first"]), changes["n"].to_numpy()
        at = found.find(digests)
        found.delete(digests[(at >= 0) & (n == 0)])
        stay = (at >= 0) & (n > 0)
        found.first[at[stay]], found.size[at[stay]] = first[stay], n[stay]
        new = (at < 0) & (n > 0)
        found.insert(digests[new], first[new], n[new])
        tidy()
        return found.table(key[0].as_py(), shards)

    return index.groupBy("shard").cogroup(live.groupBy("shard")).applyInArrow(fold, INDEX)


def decided(rows: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256): a row for every row that (id, digest, copies) stand for.

    The join's other side has one row a digest, so Spark splits a text of many copies on the side of the rows.
    """
    found = rows.join(index.select("digest", "keep_id", "group_size"), "digest")
    some = found.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = some.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("copies"), F.col("from") + COPIES) - 1)))
    kept = (F.col("copy") == 0) & F.col("id").eqNullSafe(F.col("keep_id"))
    return each.select(F.col("id").alias(key), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op11_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its equal texts.

    Null texts count as empty, and empty texts are equal; very long texts are read whole; a text's row without an id stays
    only where no row has one; of rows that agree in id and text one stays; an empty table gives no rows; other columns are
    ignored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    rows = _few(members(docs), n)
    return decided(rows, _few(build(rows), n))
