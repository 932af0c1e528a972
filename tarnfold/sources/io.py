"""Readers and writers of memory tables: JSON lines, JSON documents, CSV, Parquet, Markdown; import policies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("source", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("created_at", T.TimestampType()), T.StructField("version", T.IntegerType()), T.StructField("branch", T.StringType()),
    ]
)
CORRUPT = "_corrupt"


def write_jsonl(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = MEMORY) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that are no JSON or miss id or content."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    good = F.col(CORRUPT).isNull() & F.col("id").isNotNull() & F.col("content").isNotNull()
    return rows.where(good).drop(CORRUPT), rows.where(~good)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays as JSON text; quotes doubled, line breaks kept inside quotes."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").options(header=True, escape='"', quoteAll=True, emptyValue="").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = MEMORY) -> DataFrame:
    """Tags as JSON, else split at commas; confidence 1 by default."""
    raw = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    tags = F.coalesce(F.from_json("tags", "array<string>"), F.transform(F.split("tags", ","), F.trim))
    out = raw.withColumn("tags", tags).withColumn("confidence", F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(1.0)))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in out.columns])


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_documents(df: DataFrame) -> DataFrame:
    """One JSON string a row, in a column ``value``: a streamable document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def to_markdown(df: DataFrame) -> DataFrame:
    """(branch, value): a section a memory."""
    tags = F.concat_ws(", ", "tags")
    return df.select("branch", F.format_string("## %s\n\n%s\n\n- source: %s\n- confidence: %.2f\n- tags: %s\n", "id", "content", F.coalesce("source", F.lit("")), "confidence", tags).alias("value"))


def import_policy(base: DataFrame, incoming: DataFrame, policy: str, key: str = "id") -> DataFrame:
    """skip: known ids stay; replace: incoming rows win; error: raises if any id is known."""
    if policy == "error" and not incoming.join(base.select(key), key, "left_semi").isEmpty():
        raise ValueError("ids exist already")
    if policy == "replace":
        return base.join(incoming.select(key), key, "left_anti").unionByName(incoming)
    return base.unionByName(incoming.join(base.select(key), key, "left_anti"))


def jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, fetch: int = 1000) -> DataFrame:
    """A table of a database whose driver jar is on the class path, read in parallel ranges of a column where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def write_store(memories: DataFrame, commits: DataFrame, path: str) -> None:
    """A whole store, deleted rows and commits included, as JSON lines {"kind": ..., "row": {...}}."""
    one = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*df.columns).alias("row"))).alias("value"))
    one(memories, "memory").unionByName(one(commits, "commit")).write.mode("overwrite").text(path)


def read_store(spark: SparkSession, path: str, schema: T.StructType, kind: str = "memory") -> DataFrame:
    """Rows of one kind; lines that are no JSON or of another kind are left out."""
    line = T.StructType([T.StructField("kind", T.StringType()), T.StructField("row", schema)])
    return spark.read.text(path).select(F.from_json("value", line).alias("x")).where(F.col("x.kind") == kind).select("x.row.*")


def import_store(base: DataFrame, incoming: DataFrame, merge: bool, branch: str, key: str = "id") -> DataFrame:
    """Rows after an import: incoming ones replace known keys; without ``merge`` the branch is cleared first."""
    kept = base if merge else base.where(F.col("branch") != branch)
    return kept.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def pack_float32(vector: str) -> Column:
    """Little-endian float32 bytes of an array column, and ``unpack_float32`` back, in Arrow batches."""
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(F.col(vector))


def unpack_float32(blob: str) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return unpack(F.col(blob))
