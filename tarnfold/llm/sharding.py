"""Sharding by fixed virtual slots.

Records hash into a fixed number (thousands) of slots; bytes are aggregated per slot; a versioned slot-to-shard map
says where each slot lives, and is edited, never recomputed, when shards are added or loads are evened out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnfold.session import cut

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """One version: ``owner[slot]`` is the slot's shard. ``moves`` names what the last edit moved: (slot, from, to)."""

    version: int
    n_shards: int
    owner: tuple[int, ...]
    moves: tuple[tuple[int, int, int], ...] = field(default=())

    @classmethod
    def first(cls, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        if n_shards < 1 or n_slots < n_shards:
            raise ValueError("needs 1 <= n_shards <= n_slots")
        return cls(1, n_shards, tuple(slot % n_shards for slot in range(n_slots)))

    def _edited(self, n_shards: int, moves: list[tuple[int, int, int]]) -> SlotMap:
        owner = list(self.owner)
        for slot, _, to in moves:
            owner[slot] = to
        return SlotMap(self.version + 1, n_shards, tuple(owner), tuple(moves))

    def grown(self) -> SlotMap:
        """The next version, with one shard more: it takes its fair count of slots from the fullest shards in turn, and
        nothing else moves. Depends on this map alone, not on the data."""
        held: dict[int, list[int]] = {s: [] for s in range(self.n_shards)}
        for slot, shard in enumerate(self.owner):
            held[shard].append(slot)
        moves = []
        for _ in range(len(self.owner) // (self.n_shards + 1)):
            giver = max(held, key=lambda s: (len(held[s]), -s))
            moves.append((held[giver].pop(), giver, self.n_shards))
        return self._edited(self.n_shards + 1, moves)

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.02, max_moves: int | None = None) -> SlotMap:
        """The next version, evened out by bytes per slot: the fullest shard hands its best-fitting slot to the emptiest
        one until all are within ``tolerance`` of the mean or no move helps."""
        load, held = [0] * self.n_shards, {s: set() for s in range(self.n_shards)}
        for slot, shard in enumerate(self.owner):
            load[shard] += slot_bytes.get(slot, 0)
            held[shard].add(slot)
        mean, moves = sum(load) / self.n_shards, []
        while max_moves is None or len(moves) < max_moves:
            high, low = max(range(self.n_shards), key=lambda s: (load[s], -s)), min(range(self.n_shards), key=lambda s: (load[s], s))
            if load[high] - mean <= tolerance * mean and mean - load[low] <= tolerance * mean:
                break
            gap = load[high] - load[low]
            fits = [s for s in held[high] if 0 < slot_bytes.get(s, 0) < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
            held[high].remove(slot), held[low].add(slot)
            load[high] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
            moves.append((slot, high, low))
        return self._edited(self.n_shards, moves)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, vslot, shard), to store beside the shards."""
        schema = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType())])
        return spark.createDataFrame([(self.version, i, s) for i, s in enumerate(self.owner)], schema)

    @classmethod
    def read(cls, frame: DataFrame, version: int | None = None) -> SlotMap:
        """From a stored table of versions (thousands of rows each), the latest or the one asked for."""
        version = version if version is not None else frame.agg(F.max("version")).first()[0]
        rows = sorted((r.vslot, r.shard) for r in frame.where(F.col("version") == version).collect())
        return cls(version, max(s for _, s in rows) + 1, tuple(s for _, s in rows))


def virtual_slot(key: str = "doc_id", n_slots: int = SLOTS) -> Column:
    """The slot of a key, for good: it depends on the key alone. A null key has the slot of the hash's seed."""
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_bytes(docs: DataFrame, n_slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(vslot, rows, bytes): partial sums before the shuffle, n_slots rows after it."""
    return docs.select(virtual_slot(key, n_slots).alias("vslot"), _size(text)).groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size")


CELLS = 16
COPIES = 10_000


def assign(docs: DataFrame, slot_map: SlotMap, grown: SlotMap | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard: (key, size, text_crc32, vslot, shard, slot, grown_shard, slot_bytes).

    ``slot`` numbers a shard's rows from 0 without gaps, by (vslot, cell, key, crc, size); a cell is one of CELLS parts of a
    slot by hash of these. Rows that agree in key, crc and size are counted before any shuffle and numbered as one, so a
    key or text with many copies is one row in the window over its cell; copies come back COPIES at a time. Bytes and rows
    are summed by slot and cell; ``slot_bytes`` are those of the row's slot. A null text has 1 byte and the crc32 of
    nothing, 0; equal keys share their slot; an empty table gives no rows; other columns are ignored.
    """
    spark, n = docs.sparkSession, len(slot_map.owner)
    rows = docs.select(F.col(key).alias("_key"), _size(text), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), virtual_slot(key, n).alias("vslot"))
    alike = ["vslot", "_key", "text_crc32", "size"]
    counted = cut(rows.groupBy(alike).agg(F.count("*").alias("copies")).withColumn("cell", F.pmod(F.xxhash64("_key", "text_crc32", "size", F.lit(1)), F.lit(CELLS)).cast("int")))
    both = [(i, s, None if grown is None else grown.owner[i]) for i, s in enumerate(slot_map.owner)]
    schema = T.StructType([T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())])
    owner = spark.createDataFrame(both, schema)  # n_slots rows, whatever the data
    cells = counted.groupBy("vslot", "cell").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("bytes"))
    before = Window.partitionBy("shard").orderBy("vslot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    slots = cells.groupBy("vslot").agg(F.sum("bytes").alias("slot_bytes"))
    # n_slots * CELLS rows at most
    starts = cells.join(F.broadcast(owner), "vslot").withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(F.broadcast(slots), "vslot")
    inside = Window.partitionBy("vslot", "cell").orderBy(F.col("_key").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("nth", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(starts.select("vslot", "cell", "shard", "grown_shard", "first", "slot_bytes")), ["vslot", "cell"])
    numbered = numbered.withColumn("at", F.col("first") + F.col("nth"))
    some = numbered.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = some.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("copies"), F.col("from") + COPIES) - 1)))
    return each.select(F.col("_key").alias(key), "size", "text_crc32", "vslot", "shard", (F.col("at") + F.col("copy")).alias("slot"), "grown_shard", "slot_bytes")


def stored(spark: SparkSession, *versions: SlotMap) -> DataFrame:
    """The map's versions as a table in the shared folder."""
    frame = versions[0].frame(spark)
    for v in versions[1:]:
        frame = frame.unionByName(v.frame(spark))
    return cut(frame.coalesce(1))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the law ``key``; with a 17th shard only rows of its own move. Both versions of the
    map are stored and read back. Under this law the map's edit looks at the count of shards alone; ``slot_bytes``, as
    summed over the documents, is what ``SlotMap.rebalanced`` would work on under the law ``bytes``."""
    first = SlotMap.first(16)
    table = stored(spark, first, first.grown())
    base, grown = SlotMap.read(table, first.version), SlotMap.read(table)
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), base, grown)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "vslot", F.lit(base.version).alias("map_version"), "slot_bytes")
