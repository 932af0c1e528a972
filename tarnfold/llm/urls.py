"""URL filters: host and path rules, then association rules that Spark's FP-growth mines from labelled URLs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.session import cut

#: The item that marks a blocked row: no token, as those begin with a letter and a colon. Rules that are broadcast.
BLOCKED = "blocked"
BROADCAST_RULES = 200_000

# The given rules.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of the part after the first ``://``; both empty without one."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; equally long rules in order of their text."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct URL tokens: scheme, labels of the host, words of the path, names of query fields."""
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
            tagged("h:", F.split(host, r"[.:\-@]")),
            tagged("p:", F.split(F.lower(path), r"[^\p{L}\p{N}]+")),
            tagged("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
        )
    )


@dataclass(frozen=True)
class MinedRules:
    """Antecedents that mean block: a table (items array<array<string>>, size, confidence, support, anchor), None where
    there is none. An item is a class of tokens that stood in the same labelled rows; any of them fulfils it."""

    table: DataFrame | None

    @property
    def rules(self) -> tuple[tuple[tuple[str, ...], float, float], ...]:
        """Every antecedent written out, token by token, for looking at a few rules; matching works on the table."""
        found = [] if self.table is None else self.table.select("items", "confidence", "support").collect()
        return tuple((tuple(sorted(items)), r["confidence"], r["support"]) for r in found for items in product(*r["items"]))


def significance(n: Column, bad: Column, base: float) -> Column:
    """How many standard deviations ``bad`` of ``n`` blocked rows are over what the base rate gives."""
    return (bad - n * base) / F.sqrt(n * base * (1 - base)) if 0 < base < 1 else F.lit(0.0)


def _classes(rows: DataFrame, least: int) -> DataFrame:
    """(token, item): tokens of at least ``least`` blocked rows, by the first token of those that stand in the very same rows
    (told apart by two 64-bit hash sums and the count). Without this, n tokens that always come together would be 2^n
    frequent sets of one meaning."""
    each = rows.select("row", F.col("blocked").cast("int").alias("y"), F.explode(F.array_distinct("tokens")).alias("token"))
    hashed = lambda salt: F.sum(F.xxhash64(F.lit(salt), "row").cast("decimal(38,0)"))
    per = cut(each.groupBy("token").agg(F.sum("y").alias("bad"), F.count("*").alias("n"), hashed(1).alias("a"), hashed(2).alias("b")).where(F.col("bad") >= least))
    same = ["n", "bad", "a", "b"]
    return per.join(per.groupBy(same).agg(F.min("token").alias("item")), same).select("token", "item", "n")


def mine(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.6, min_rows: int = 20, min_z: float = 4.0) -> MinedRules:
    """From all (tokens, blocked) rows, by Spark's FP-growth. Null tokens make no rules.

    Rows become transactions of their frequent items, with one more item where they are blocked; a frequent set with
    that item and the same set without it give a rule's support and confidence. A rule is kept where no part of it has
    at least its confidence: level by level, each set looks at its parts of one item less. ``min_rows`` and ``min_z``
    (standard deviations over the base rate) are further bounds for callers who want them; 1 and 0 leave support and
    confidence alone. Sets are joined and pruned as tables; the driver sees counts, and FP-growth's list of frequent items.
    """
    rows = cut(labelled.select("tokens", F.coalesce("blocked", F.lit(False)).alias("blocked")).withColumn("row", F.monotonically_increasing_id()))
    n, bad = rows.agg(F.count("*"), F.count_if("blocked")).first()
    if not n or not bad:
        return MinedRules(None)
    least = max(1, min_rows, math.ceil(min_support * n))
    classes = cut(_classes(rows, least))
    if classes.isEmpty():
        return MinedRules(None)
    items = rows.select("row", "blocked", F.explode(F.array_distinct("tokens")).alias("token")).join(classes, "token").groupBy("row", "blocked").agg(F.collect_set("item").alias("items"))
    baskets = cut(items.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCKED))).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / baskets.count())).fit(baskets)
    sets = cut(model.freqItemsets)
    sign = F.array_contains("items", BLOCKED)
    both = sets.where(sign & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCKED)).alias("items"), F.col("freq").alias("bad"))
    found = cut(both.join(sets.where(~sign).select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "items").withColumn("confidence", F.col("bad") / F.col("n")).withColumn("size", F.size("items")))
    longest = found.agg(F.max("size")).first()[0] or 0
    levels, below = [], None
    for size in range(1, longest + 1):
        level = found.where(F.col("size") == size)
        if below is None:
            level = level.withColumn("top", F.lit(0.0))
        else:
            parts = level.select("items", F.explode("items").alias("x")).select("items", F.array_remove("items", F.col("x")).alias("part"))
            tops = parts.join(below, "part").groupBy("items").agg(F.max("best").alias("top"))
            level = level.join(tops, "items")
        level = cut(level)
        below = level.select(F.col("items").alias("part"), F.greatest("confidence", "top").alias("best"))
        levels.append(level)
    chosen = reduce(DataFrame.unionByName, levels).where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("top")))
    if min_z > 0:
        chosen = chosen.where(significance(F.col("n"), F.col("bad"), bad / n) >= min_z)
    # items by the tokens they stand for; the rarest item is the anchor under which a rule is found
    chosen = chosen.select(F.monotonically_increasing_id().alias("rule"), "items", "size", "confidence", (F.col("bad") / n).alias("support"))
    chosen = cut(chosen)
    if chosen.isEmpty():
        return MinedRules(None)
    told = classes.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("of"), F.first("n").alias("n"))  # in one class: tokens of one row
    each = chosen.select("rule", F.explode("items").alias("item")).join(told, "item").groupBy("rule").agg(F.array_sort(F.collect_list("of")).alias("items"), F.min(F.struct("n", "of")).alias("rare"))
    return MinedRules(cut(each.join(chosen.drop("items"), "rule").select("items", "size", "confidence", "support", F.col("rare.of").alias("anchor"))))


def match(rows: DataFrame, mined: MinedRules, column: str = "tokens", into: str = "mined") -> DataFrame:
    """``into``: the antecedent of the most confident rule whose items a row has all of, joined by '+' (an item by its first
    token that the row has), else null.

    The inverted index lists a rule under the tokens of its rarest item; a row's tokens look it up by a join, and what they
    find is verified against the whole row. The index is broadcast up to a checked number of entries.
    """
    if mined.table is None:
        return rows.withColumn(into, F.lit(None).cast("string")).drop(column)
    index = mined.table.select(F.explode("anchor").alias("_token"), "items", "confidence")
    index = F.broadcast(index) if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else index
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    # a long row's tokens aren't copied once a token: they come back for what was found
    met = rows.select("_row", F.explode(F.array_distinct(column)).alias("_token")).join(index, "_token").select("_row", "items", "confidence").distinct()
    met = met.join(rows.select("_row", F.col(column).alias("_has")), "_row")
    shown = F.transform("items", lambda item: F.get(F.array_intersect(item, F.col("_has")), F.lit(0)))
    met = met.select("_row", "confidence", shown.alias("shown")).where(F.forall("shown", lambda x: x.isNotNull()))
    best = met.groupBy("_row").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.array_sort("shown").alias("shown"))).alias("m"))
    return rows.drop(column).join(best.select("_row", F.array_join("m.shown", "+").alias(into)), "_row", "left").drop("_row")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, key: str = "page_id", url: str = "url", **bounds) -> DataFrame:
    """Each URL with host, path, rule, verdict and the mined rule that fitted, if any.

    A listed rule decides; else a mined rule means block; else allow. ``labelled`` has (url, blocked). A null URL or one
    without ``://`` has an empty host and path, no tokens but its scheme's, and is allowed; repeated rows come back
    each; an empty table gives no rows; other columns are ignored.
    """
    mined = MinedRules(None)
    if labelled is not None:
        h, p = host_path(F.col("url"))
        mined = mine(labelled.where("url is not null and blocked is not null").select(tokens(F.col("url"), h, p).alias("tokens"), "blocked"), **bounds)
    h, p = host_path(F.col(url))
    rows = pages.select(F.col(key), F.col(url).alias("_url"), h.alias("host"), p.alias("path"))
    rule, says = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_says": says})
    rows = match(rows.withColumn("tokens", F.coalesce(tokens(F.col("_url"), F.col("host"), F.col("path")), F.array().cast("array<string>"))), mined)
    verdict = F.coalesce("_says", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return rows.select(key, "host", "path", "rule", verdict.alias("verdict"), "mined")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; labels (quality 0 means block) belong to the page of the same number. Rules are pruned by support (1 % of
    the labelled rows) and confidence (60 %) alone, on a table of any size."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("blocked"))
    return judge(pages, pages.join(labels, "page_id").select("url", "blocked"), min_support=0.01, min_rows=1, min_z=0.0)
