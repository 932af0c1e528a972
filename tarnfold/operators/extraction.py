"""Facts, key-value pairs, relations, entities and dates from text by rule tables; facts deduplicated and resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.functions import rules as rl


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(group))


def extract_facts(rows: DataFrame, key: str, text: str, rules=rl.FACTS, keyed=rl.KEYED_FACTS) -> DataFrame:
    """(key, domain, fact, value, confidence): every match of every rule, values stripped, of more than one character.
    One projection and an explode: no shuffle."""
    t = F.col(text)
    parts = [F.transform(_all(t, p), _fact(domain, F.lit(name), conf)) for p, name, domain, conf in rules]
    for p, name, domain, conf in keyed:
        pairs = F.arrays_zip(_all(t, p, 1).alias("k"), _all(t, p, 2).alias("v"))
        parts.append(F.transform(pairs, _keyed(domain, name, conf)))
    got = rows.select(key, F.explode(F.flatten(F.array(*parts))).alias("f")).select(key, "f.*")
    return got.where(F.length("value") > 1)


def _fact(domain: str, name: Column, conf: float):
    return lambda v: F.struct(F.lit(domain).alias("domain"), name.alias("fact"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value"), F.lit(conf).alias("confidence"))


def _keyed(domain: str, name: str, conf: float):
    return lambda p: F.struct(F.lit(domain).alias("domain"), F.concat(F.lit(name), F.lower(p["k"])).alias("fact"), F.regexp_replace(p["v"], r"^\s+|\s+$", "").alias("value"), F.lit(conf).alias("confidence"))


def extract_key_values(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of lines ``name: value`` or ``name = value``."""
    lines = rows.select(key, F.explode(F.split(text, "\n")).alias("line"))
    pattern = r"^([a-zA-Z_]+)\s*[:=]\s*(.+)$"
    return lines.where(F.col("line").rlike(pattern)).select(key, F.lower(F.regexp_extract("line", pattern, 1)).alias("name"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))


def extract_relations(rows: DataFrame, key: str, text: str, rules=rl.RELATIONS) -> DataFrame:
    """Distinct (key, subject, predicate, object). A rule's names may begin at any word, so its verb is looked for first."""
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string>>")
    found = lambda p, name: F.transform(F.arrays_zip(_all(F.col(text), p, 1).alias("s"), _all(F.col(text), p, 2).alias("o")), _triple(name))
    parts = [F.coalesce(F.when(F.col(text).rlike("(?i)" + rl.between(p)), found(p, name)), none) for p, name in rules]
    return rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("t")).select(key, "t.*")


def _triple(name: str):
    return lambda p: F.struct(p["s"].alias("subject"), F.lit(name).alias("predicate"), p["o"].alias("object"))


def extract_dates(text: Column) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in rl.DATES]))


def dedupe_facts(facts: DataFrame, order: str) -> DataFrame:
    """Per (domain, lower fact, lower value) the highest confidence, the first in ``order`` among equals."""
    rest = [c for c in facts.columns]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), -F.col(order)))
    return facts.groupBy("domain", F.lower("fact").alias("_f"), F.lower("value").alias("_v")).agg(best.alias("b")).select("b.*")


def conflicting_facts(facts: DataFrame) -> DataFrame:
    """(domain, fact, conflicts): pairs of one key with different values, counted from value counts, not by pairing."""
    per = facts.groupBy("domain", F.lower("fact").alias("fact"), F.lower("value").alias("value")).agg(F.count("*").alias("c"))
    got = per.groupBy("domain", "fact").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return got.select("domain", "fact", ((F.col("n") * (F.col("n") - 1) - F.col("same")) / 2).cast("long").alias("conflicts")).where("conflicts > 0")


def resolve_facts(facts: DataFrame, strategy: str, order: str) -> DataFrame:
    """One row per (domain, lower fact): by confidence or by latest ``order``; keep_both numbers them key_v1, key_v2, ..."""
    if strategy == "keep_both":
        w = Window.partitionBy("domain", F.lower("fact")).orderBy(order, "confidence", "value")
        return facts.withColumn("fact", F.concat("fact", F.lit("_v"), F.row_number().over(w).cast("string")))
    by = F.struct(F.col("confidence"), -F.col(order)) if strategy == "confidence" else F.struct(F.col(order), F.col("confidence"))
    return facts.groupBy("domain", F.lower("fact").alias("_f")).agg(F.max_by(F.struct(*facts.columns), by).alias("b")).select("b.*")


def extract_entities(rows: DataFrame, key: str, text: str, rules=rl.ENTITIES, excluded=tuple(rl.NO_ENTITIES)) -> DataFrame:
    """Distinct (key, name, type) by lower-cased name, the first spelling in order; excluded words go."""
    parts = [F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), _entity(kind)) for p, kind in rules]
    got = rows.select(key, F.explode(F.flatten(F.array(*parts))).alias("e")).select(key, "e.*")
    got = got.where(~F.lower("name").isin([w.lower() for w in excluded])) if excluded else got
    return got.groupBy(key, F.lower("name").alias("_n"), "type").agg(F.min("name").alias("name")).select(key, "name", "type")


def _entity(kind: str):
    return lambda v: F.struct(v.alias("name"), F.lit(kind).alias("type"))


def entity_links(entities: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Dimension (name, type, mentions) and bridge (key, name, type) of extracted entities."""
    return entities.groupBy(F.lower("name").alias("name"), "type").agg(F.count("*").alias("mentions")), entities.select(key, F.lower("name").alias("name"), "type").distinct()
