"""Structured Streaming forms of incremental operators: windows, sessions, upserts. All run to the end of what is there
(available now) and keep state and progress in a checkpoint folder of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.session import remove


def stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run(df: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> None:
    """Each batch replaces ``out`` (complete), or a folder of its own number in it (append; ``appended`` reads them), so a
    repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def appended(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def windowed_counts(events: DataFrame, ts: str, size: str, late: str, by: list[str]) -> DataFrame:
    """Tumbling windows with a watermark; late rows beyond it are left out."""
    got = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), *by, "n", "total")


def session_counts(events: DataFrame, ts: str, gap: str, late: str, by: list[str]) -> DataFrame:
    got = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return got.select(*by, F.col("w.start").alias("first_at"), F.col("w.end").alias("closes_at"), "n")


#: Parts of an upserted table by hash of the key: a batch rewrites those that it touches.
BUCKETS = 64


def upsert_batches(incoming: DataFrame, target: str, key: str, version: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Keeps the highest version of each key. A batch rewrites the buckets of its keys, in ``target``.data under its own number,
    and the manifest of that number in ``target`` says which batch holds which bucket; a repeated batch writes the same
    again. Of older manifests the last one stays, and what only earlier ones pointed to is removed."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, target, number - 1)
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        known = [_bucket(target, before[b], b) for b in touched if b in before]
        old = spark.read.option("basePath", f"{target}.data").parquet(*known).select(*rows.columns) if known else None
        order = Window.partitionBy("bucket", key).orderBy(F.desc(version))
        merged = (rows.unionByName(old) if old is not None else rows).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}.data/batch={number}")
        now = before | {b: number for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, number int").coalesce(1).write.mode("overwrite").parquet(f"{target}/{number}")
        rows.unpersist()
        for b, n in _manifest(spark, target, number - 2).items():
            if before.get(b) != n:
                remove(spark, _bucket(target, n, b))
        remove(spark, f"{target}/{number - 2}")

    incoming.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def _bucket(target: str, number: int, bucket: int) -> str:
    return f"{target}.data/batch={number}/bucket={bucket}"


def _manifest(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """Which batch holds each bucket after batch ``number``: a row a bucket."""
    path = f"{target}/{number}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if number < 0 or not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    return {r["bucket"]: r["number"] for r in spark.read.parquet(path).collect()}


def latest_table(spark: SparkSession, target: str, number: int) -> DataFrame:
    """The table after batch ``number``."""
    held = [_bucket(target, n, b) for b, n in sorted(_manifest(spark, target, number).items())]
    if not held:
        raise ValueError(f"no batch {number} in {target}")
    return spark.read.option("basePath", f"{target}.data").parquet(*held).drop("batch", "bucket")
