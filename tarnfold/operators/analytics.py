"""Facets, store statistics, metric aggregates and dashboards, as flat aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def terms_facet(docs: DataFrame, field: str, min_count: int = 1, limit: int = 100) -> DataFrame:
    """(value, count), most frequent first, ties by value; arrays are exploded, nulls skipped."""
    value = F.explode(field) if dict(docs.dtypes)[field].startswith("array") else F.col(field)
    got = docs.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
    return got.where(F.col("count") >= min_count).orderBy(F.desc("count"), "value").limit(limit)


def date_bucket(ts: Column, size: str) -> Column:
    return F.date_format(F.date_trunc(size, ts), BUCKETS[size])


def date_facet(docs: DataFrame, field: str, size: str) -> DataFrame:
    return docs.where(F.col(field).isNotNull()).groupBy(date_bucket(F.col(field), size).alias("bucket")).agg(F.count("*").alias("count"))


def range_facet(docs: DataFrame, field: str, n: int = 5) -> DataFrame:
    """Equal widths from least to most, the last one closed; only those with rows."""
    v = docs.select(F.col(field).cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / n
    i = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / F.when(width > 0, width)), F.lit(n - 1))).otherwise(0)
    rows = v.crossJoin(F.broadcast(ends)).select(i.cast("int").alias("i"), "low", width.alias("w"))
    label = F.format_string("%.2f-%.2f", F.col("low") + F.col("i") * F.col("w"), F.col("low") + (F.col("i") + 1) * F.col("w"))
    return rows.groupBy("i", "low", "w").agg(F.count("*").alias("count")).select("i", label.alias("label"), "count")


def filter_suggestions(docs: DataFrame, fields: list[str], n: int = 5) -> DataFrame:
    """(facet, value, count): the n most frequent values of each field, in one pass."""
    pairs = docs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")).select("p.*").where("value is not null")
    got = pairs.groupBy("facet", "value").agg(F.count("*").alias("count"))
    order = Window.partitionBy("facet").orderBy(F.desc("count"), "value")
    return got.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")


def with_share(counts: DataFrame, count: str = "count") -> DataFrame:
    """Percentages of a grouped result (one row a group)."""
    return counts.withColumn("percentage", 100.0 * F.col(count) / F.sum(count).over(Window.partitionBy()))


def memory_stats(rows: DataFrame, content: str = "content", created: str = "created_at", deleted: str = "is_deleted") -> DataFrame:
    live = ~F.col(deleted)
    return rows.agg(
        F.count_if(live).alias("active"),
        F.count_if(F.col(deleted)).alias("deleted"),
        F.avg(F.when(live, F.length(content))).alias("avg_length"),
        F.min(F.when(live, F.col(created))).alias("first_at"),
        F.max(F.when(live, F.col(created))).alias("last_at"),
    )


def daily_counts(rows: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAY")).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def cumulative_histogram(rows: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """(by..., le, count): counts at or below each bound, from one aggregate."""
    got = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count("*").alias("_inf"))
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("count")))
    return got.select(*by, F.explode(pairs).alias("p")).select(*by, "p.le", "p.count")


def source_reliability(rows: DataFrame, source: str, rejected: Column, trust: Column) -> DataFrame:
    """(trust + max(0, 1 - 2 * rejected share)) / 2; suspicious from 10 records with more than half rejected."""
    got = rows.groupBy(source).agg(F.count("*").alias("total"), F.count_if(rejected).alias("rejected"), F.max(trust).alias("trust"))
    share = F.col("rejected") / F.col("total")
    return got.select(source, "total", "rejected", ((F.col("trust") + F.greatest(F.lit(0.0), 1 - 2 * share)) / 2).alias("reliability"), ((F.col("total") >= 10) & (share > 0.5)).alias("suspicious"))


def search_trends(log: DataFrame, query: str, ts: str, as_of, days: int, n: int = 10) -> DataFrame:
    """The most frequent queries, lower-cased and stripped, of the last days."""
    recent = log.where(F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAY"))
    return recent.groupBy(F.trim(F.lower(F.col(query))).alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(n)


def prometheus_text(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Exposition lines ``name{label="..."} value`` of (labels..., value) rows, in a column ``line``."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return metrics.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def audit_summary(events: DataFrame, kind: str, severity: Column) -> DataFrame:
    """Counts by kind and severity."""
    return events.groupBy(F.col(kind).alias("kind"), severity.alias("severity")).agg(F.count("*").alias("n"))


def hit_ratio(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), (F.count_if(hit) / F.count("*")).alias("ratio"))
