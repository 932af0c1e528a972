"""Token ids in wavelet-matrix shards: succinct bit-planes with rank and select, one compressed blob a shard."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.llm.byte_bpe import load
from tarnfold.session import checkpoint_dir

MAGIC = b"WVM1"
BLOCK = 512
SHARD_TOKENS = 4_000_000


class WaveletMatrix:
    """A sequence of unsigned numbers as one bit-plane a level, highest bit first; each level holds its values with
    those of bit 0 first. ``ranks[l][b]`` counts the ones of level l before block b of 512 bits."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @property
    def bits(self) -> int:
        return len(self.planes)

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        if bits is None:
            bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        planes, zeros, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (values & values.dtype.type(1 << level)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            ranks.append(cls._directory(planes[-1]))
            none = ~ones
            low = values[none]
            zeros.append(len(low))
            values = np.concatenate([low, values[ones]])
        return cls(len(values), planes, zeros, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(plane) * 8 // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(plane)] = plane
        counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a level before position i."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : -(-i // 8)]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(part).sum(dtype=np.int64))
        return ones - (int(part[-1]) >> (i % 8)).bit_count() if i % 8 and len(part) else ones

    def _select1(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th (from 0) one or zero of a level."""
        rank = self.ranks[level].astype(np.int64)
        before = rank if one else np.arange(len(rank)) * BLOCK - rank
        block = int(np.searchsorted(before, k, "right")) - 1
        part = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == one)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            one = self.planes[level][i // 8] >> (i % 8) & 1
            before = self._rank1(level, i)
            value, i = value * 2 + int(one), self.zeros[level] + before if one else i - before
        return value

    def _range(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a symbol in [start, end)."""
        if symbol >> self.bits:
            return 0
        a, b = self._range(symbol, start, self.n if end is None else end)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Position of the symbol's k-th occurrence, from 0."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, 0, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(symbol >> (self.bits - 1 - level) & 1)
            i = self._select1(level, i - self.zeros[level] if one else i, one)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def values(self) -> np.ndarray:
        """All values in order, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            here = np.empty(self.n, kind)
            here[ones] = out[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            here[~ones] = out[: self.zeros[level]]
            out = here
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sIQ", MAGIC, self.bits, self.n) + np.array(self.zeros, np.uint64).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *[r.tobytes() for r in self.ranks], *[p.tobytes() for p in self.planes]]))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        data = zstandard.ZstdDecompressor().decompress(data)
        magic, bits, n = struct.unpack_from("<4sIQ", data)
        if magic != MAGIC:
            raise ValueError("no wavelet matrix")
        at = 16
        take = lambda count, kind: (np.frombuffer(data, kind, count, at), at + count * np.dtype(kind).itemsize)
        zeros, at = take(bits, np.uint64)
        width, ranks, planes = -(-n // 8), [], []
        blocks = -(-width * 8 // BLOCK) + 1
        for _ in range(bits):
            x, at = take(blocks, np.uint32)
            ranks.append(x)
        for _ in range(bits):
            x, at = take(width, np.uint8)
            planes.append(x)
        return cls(n, planes, [int(z) for z in zeros], ranks)


SHARDS = "part long, seq long, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, body binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every whole text, appends ``end_id`` and writes shards of whole documents in ascending key order.

    A shard is one row of the Parquet table at ``path``: its place (part, seq), keys and lengths, and the compressed
    wavelet matrix. Parts are ranges of the key, so shards in the order (part, seq) hold the keys in order; equal keys
    stand together in the order of their text; null keys come first. A shard closes at ``shard_tokens`` or after the document that
    passes it. Null is read as the empty text. The vocabulary file is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    tail = b"" if end_id is None else np.array([end_id], np.uint16).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = load(shared.value).packed, TaskContext.get().partitionId(), 0
        keys, lengths, packed, n = [], [], [], 0

        def shard() -> pa.RecordBatch:
            body = WaveletMatrix.build(np.frombuffer(b"".join(packed), np.uint16)).to_bytes()
            values = [[part], [seq], [len(keys)], [n], [keys], [lengths], [body]]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["part", "seq", "n_docs", "n_tokens", "doc_ids", "lengths", "body"])

        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                ids = encode(t) + tail
                keys.append(k), lengths.append(len(ids) // 2), packed.append(ids)
                n += len(ids) // 2
                if n >= shard_tokens:
                    yield shard()
                    keys, lengths, packed, n, seq = [], [], [], 0, seq + 1
        if keys:
            yield shard()

    rows.mapInArrow(work, SHARDS).write.option("compression", "none").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, first): ids before each shard. Sums run over parts, then over the shards of one part."""
    shards = spark.read.parquet(path).select("part", "seq", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n_tokens").over(before.orderBy("part")), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", ahead.alias("p0"))
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    return shards.withColumn("s0", inside).join(parts, "part").select("part", "seq", (F.col("p0") + F.col("s0")).alias("first"))


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Each document from the shards: (doc_id, part, seq, local, n_tokens, ids_crc32[, ids])."""
    schema = "doc_id long, part long, seq long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = WaveletMatrix.from_bytes(row["body"]).values().astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw, crcs = memoryview(values).cast("B"), []
                for a, b in zip(ends - lengths, ends):
                    crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
                size = len(lengths)
                cols = [pa.array(row["doc_ids"], pa.int64()), *[pa.array(np.full(size, row[c], np.int64)) for c in ("part", "seq")], pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                names = ["doc_id", "part", "seq", "local", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), values.astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return spark.read.parquet(path).select("part", "seq", "doc_ids", "lengths", "body").mapInArrow(work, schema)


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path).join(starts(spark, path), ["part", "seq"]).withColumn("start", F.col("first") + F.col("local"))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to the shared folder and read back."""
    path = f"{checkpoint_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, byte_vocabulary())
    return with_starts(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "seq")
