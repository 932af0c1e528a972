"""SQLite stores as a source and a sink, through Spark's Python data source API.

A store is one file or a folder of files that hold a table of the same name. Reading is dealt out by ranges of rowid, with filters
and columns handed to SQLite; writing makes a file a task, which appear together when the job commits. The driver lists
files, executors read and write them, so the path is one that all of them mount.
"""

from __future__ import annotations

import datetime
import decimal
import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_A_PART, ROWS_A_FILE, BATCH = 50_000, 20_000, 4096
ENDING = ".sqlite"
_SIMPLE = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}
#: SQLite compares these as Spark does.
SIGNS = ("=", "<", "<=", ">", ">=", "in")
_COMPARED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType)


def local_path(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"SQLite needs a mounted path, not {path}")
    return path.removeprefix("file://")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ENDING)) if os.path.isdir(path) else []


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def _stored(value, kind: T.DataType):
    """As SQLite keeps it: numbers, text and bytes as they are, times and nested values as text. NaN is text too, as SQLite
    would make it null."""
    if value is None or isinstance(kind, (T.StringType, T.BinaryType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return value
    if isinstance(kind, T.BooleanType):
        return int(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value if value == value else "NaN"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.isoformat()
    if isinstance(kind, T.DecimalType):
        return str(value)
    return json.dumps(value, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else v.hex() if isinstance(v, bytes) else str(v), ensure_ascii=False)


def _read(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(value)
    if type(kind) in _SIMPLE:
        return value
    found = json.loads(value)
    return [tuple(pair) for pair in found] if isinstance(kind, T.MapType) else found


def schema_of(path: str, table: str) -> T.StructType:
    """The schema that the sink wrote beside the table, else one by SQLite's column types."""
    found = files(path)
    if not found:
        raise FileNotFoundError(f"no SQLite store at {path}")
    with closing(_opened(found[0])) as con:
        if con.execute("select 1 from sqlite_master where name = '_spark_schema'").fetchone():
            row = con.execute("select json from _spark_schema where name = ?", (table,)).fetchone()
            if row:
                return T.StructType.fromJson(json.loads(row[0]))
        columns = con.execute(f"pragma table_info({_quoted(table)})").fetchall()
    if not columns:
        raise ValueError(f"no table {table!r} in {found[0]}")
    kind = lambda t: T.LongType() if "INT" in t else T.DoubleType() if any(k in t for k in ("REAL", "FLOA", "DOUB")) else T.BinaryType() if "BLOB" in t or not t else T.StringType()
    return T.StructType([T.StructField(c[1], kind((c[2] or "").upper())) for c in columns])


@dataclass
class Part(ds.InputPartition):
    path: str
    low: int
    high: int


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, rows: int, filters: list[list]):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows
        kinds = {f.name: type(f.dataType) for f in schema_of(path, table).fields}
        self.where: list[str] = []
        self.values: list = []
        for name, sign, value in filters:
            if sign == "null":
                self.where.append(f"{_quoted(name)} is {'' if value else 'not '}null")
                continue
            if sign not in SIGNS or kinds.get(name) not in _COMPARED:
                raise ValueError(f"can't hand down {name} {sign}")
            values = list(value) if sign == "in" else [value]
            self.where.append(f"{_quoted(name)} {sign} " + (f"({', '.join('?' * len(values))})" if sign == "in" else "?"))
            self.values += values

    def partitions(self) -> list[Part]:
        out = []
        for path in files(self.path):
            with closing(_opened(path)) as con:
                low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            if low is not None:
                out += [Part(path, a, min(high, a + self.rows - 1)) for a in range(low, high + 1, self.rows)]
        return out or [Part("", 0, -1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names, kinds = self.schema.names, [f.dataType for f in self.schema.fields]
        arrow = to_arrow_schema(self.schema)
        sql = f"select {', '.join(map(_quoted, names))} from {_quoted(self.table)} where {' and '.join(['rowid between ? and ?', *self.where])}"
        with closing(_opened(partition.path)) as con:
            cursor = con.execute(sql, [partition.low, partition.high, *self.values])
            while rows := cursor.fetchmany(BATCH):
                columns = [[_read(v, kind) for v in column] for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


@dataclass
class Written(ds.WriterCommitMessage):
    file: str


class Writer(ds.DataSourceArrowWriter):
    """Tasks write to a staging folder beside the store; committing moves what the successful ones named, and then removes
    the former files where the mode is overwrite. A failed job leaves nothing behind."""

    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = path, table, schema, overwrite
        self.staging = os.path.join(path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        os.makedirs(self.staging, exist_ok=True)
        file = os.path.join(self.staging, f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}{ENDING}")
        kinds = [f.dataType for f in self.schema.fields]
        made = ", ".join(f"{_quoted(f.name)} {_SIMPLE.get(type(f.dataType), 'TEXT')}" for f in self.schema.fields)
        with closing(sqlite3.connect(file)) as con:
            con.execute("pragma journal_mode = off")
            con.execute(f"create table {_quoted(self.table)} ({made})")
            con.execute("create table _spark_schema (name text, json text)")
            con.execute("insert into _spark_schema values (?, ?)", (self.table, self.schema.json()))
            insert = f"insert into {_quoted(self.table)} values ({', '.join('?' * len(kinds))})"
            for batch in iterator:
                columns = [[_stored(v, kind) for v in column.to_pylist()] for column, kind in zip(batch.columns, kinds)]
                con.executemany(insert, zip(*columns))
            con.commit()
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        before = files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.file, os.path.join(self.path, os.path.basename(m.file)))
        for f in before:
            os.remove(f)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class SqliteStore(ds.DataSource):
    """Options: path, table (rows), parts by rows_a_part, and for reading columns (a,b,...) and filters, a JSON list of
    [column, sign, value]. Filters are an option and not taken from the plan: Spark 4.1 hands a Python source's reader on from
    one plan of a DataFrame to the next, with the filters of the first."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_store"

    def _at(self) -> tuple[str, str]:
        return local_path(self.options["path"]), self.options.get("table", "rows")

    def schema(self) -> T.StructType:
        found = schema_of(*self._at())
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return T.StructType([found[c] for c in wanted]) if wanted else found

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(*self._at(), schema, int(self.options.get("rows_a_part", ROWS_A_PART)), json.loads(self.options.get("filters", "[]")))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(*self._at(), schema, overwrite)


def write_sqlite(df: DataFrame, path: str, table: str = "rows", mode: str = "append") -> None:
    df.sparkSession.dataSource.register(SqliteStore)
    df.write.format("sqlite_store").mode(mode).option("table", table).save(path)


def read_sqlite(spark: SparkSession, path: str, table: str = "rows", columns: list[str] | None = None, filters: list[tuple] | None = None, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """``filters`` hold together and are answered by SQLite: (column, sign, value) of SIGNS over whole numbers and text, or
    (column, "null", whether it is)."""
    spark.dataSource.register(SqliteStore)
    reader = spark.read.format("sqlite_store").option("table", table).option("rows_a_part", rows_a_part).option("filters", json.dumps(filters or []))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)
