"""SQLite stores: round trips of all kinds of columns, filters handed down, ranges, failed jobs."""

import datetime
import decimal
import math
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tarnfold.plans.consolidate import _folder
from tarnfold.sources import sqlite

KINDS = "id long, name string, blob binary, ok boolean, x double, v array<float>, at timestamp, day date, price decimal(12,2), tags map<string,int>, s struct<a:int,b:string>"
ROWS = [
    (1, "a 'quoted\" \n é", b"\x00\xff", True, 1.5, [0.1, 2.0], datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), datetime.date(2024, 2, 29), decimal.Decimal("12.30"), {"k": 1}, (1, "b")),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", b"", False, math.nan, [], datetime.datetime(1969, 12, 31), datetime.date(1, 1, 1), decimal.Decimal("-0.01"), {}, (None, None)),
    (2**62, "z" * 100_000, b"z", True, math.inf, [1.0] * 500, None, None, None, {"q": None}, (5, "")),
]


def at(spark, name):
    return sqlite.local_path(_folder(spark, name))


def shown(rows):
    return sorted(repr(tuple("nan" if isinstance(v, float) and v != v else bytes(v) if isinstance(v, bytearray) else v for v in r)) for r in rows)


def test_all_kinds_of_columns(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    path = at(spark, "kinds")
    sqlite.write_sqlite(df.repartition(3), path)
    got = sqlite.read_sqlite(spark, path)
    assert got.schema == df.schema and shown(got.collect()) == shown(df.collect())
    assert shown(sqlite.read_sqlite(spark, path, columns=["name", "id"]).collect()) == shown(df.select("name", "id").collect())


def test_partitions_and_pushed_filters(spark):
    path = at(spark, "parts")
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("int").alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 2 == 0, F.col("id") / 2).alias("x"))
    sqlite.write_sqlite(df.coalesce(2), path, "t")
    got = sqlite.read_sqlite(spark, path, "t", rows_a_part=100)
    assert got.rdd.getNumPartitions() >= 10
    for where in ("id = 5", "k IN (1, 2) AND x IS NOT NULL", "id = 4 OR k = 2", "name <=> NULL"):
        assert shown(got.where(where).collect()) == shown(df.where(where).collect()), where
    for filters, where in (([("id", "=", 5)], "id = 5"), ([("id", ">=", 990), ("k", "=", 3)], "id >= 990 AND k = 3"), ([("name", "=", "n77")], "name = 'n77'"), ([("k", "in", [1, 2]), ("x", "null", False)], "k IN (1, 2) AND x IS NOT NULL"), ([("x", "null", True), ("id", "<", 9)], "x IS NULL AND id < 9"), ([("name", ">", "n98")], "name > 'n98'")):
        some = sqlite.read_sqlite(spark, path, "t", ["k", "name"], filters, 100)
        assert shown(some.collect()) == shown(df.where(where).select("k", "name").collect()), where
    for bad in (("x", ">", 1.0), ("id", "like", "5"), ("nosuch", "=", 1)):
        with pytest.raises(Exception):
            sqlite.read_sqlite(spark, path, "t", filters=[bad]).collect()


def test_append_overwrite_and_failed_jobs(spark):
    path = at(spark, "modes")
    one = spark.range(10).select("id")
    sqlite.write_sqlite(one, path)
    sqlite.write_sqlite(one.select((F.col("id") + 10).alias("id")), path)
    assert sorted(r[0] for r in sqlite.read_sqlite(spark, path).collect()) == list(range(20))
    before = sorted(os.listdir(path))
    fails = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        sqlite.write_sqlite(fails, path)
    assert sorted(os.listdir(path)) == before
    sqlite.write_sqlite(one, path, mode="overwrite")
    assert sorted(r[0] for r in sqlite.read_sqlite(spark, path).collect()) == list(range(10)) and not set(os.listdir(path)) & set(before)
    sqlite.write_sqlite(one.limit(0), path, mode="overwrite")
    assert sqlite.read_sqlite(spark, path).collect() == []


def test_a_store_that_spark_did_not_write(spark):
    path = at(spark, "plain")
    os.makedirs(path)
    file = os.path.join(path, "store.db")
    con = sqlite3.connect(file)
    con.execute("create table memories (id text primary key, content text, version integer, score real, embedding_blob blob)")
    con.executemany("insert into memories values (?, ?, ?, ?, ?)", [(f"m{i}", f"text {i}", i, i / 2, bytes([i])) for i in range(30)])
    con.commit()
    con.close()
    got = sqlite.read_sqlite(spark, file, "memories", rows_a_part=7)
    assert dict(got.dtypes) == {"id": "string", "content": "string", "version": "bigint", "score": "double", "embedding_blob": "binary"}
    assert got.where("version >= 28").orderBy("version").collect()[0]["content"] == "text 28" and got.count() == 30
    with pytest.raises(Exception):
        sqlite.read_sqlite(spark, path + "/nowhere", "memories").count()
    with pytest.raises(ValueError):
        sqlite.local_path("s3://bucket/x")
