"""Mixing sources to target weights, by temperature.

Token shares p_s are raised to an exponent and normalised, w_s = p_s^a / sum p^a; a is bisected until the weights reach
a target entropy, or until no source is repeated more than a limit allows. A token budget times w_s is then laid over
each source's documents in a fixed random order, the order being cut in blocks and sub-blocks by hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.session import cut


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised p^exponent; sources without tokens get nothing."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = math.fsum(raised.values())
    return {s: x / norm for s, x in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    """In nats."""
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_exponent(tokens: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1] nearest to 1 with at least ``target_entropy`` (as a share of the largest, log of the
    number of sources that have tokens), or else nearest to 0 with no source repeated more than ``max_repeats`` times
    (budget * w_s <= max_repeats * tokens_s). With both, the repetition limit wins. Entropy falls and the scarcest
    source's repeats fall as the exponent grows, so both are bisected."""
    live = {s: n for s, n in tokens.items() if n}
    if len(live) < 2:
        return 1.0
    budget = sum(live.values()) if budget is None else budget

    def last(ok, lo: float, hi: float) -> float:
        """Between lo (ok) and hi (not ok), the end of what is ok."""
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    a = 1.0
    if target_entropy is not None:
        enough = lambda x: entropy(weights_at(live, x)) >= target_entropy * math.log(len(live))
        a = 1.0 if enough(1.0) else last(enough, 0.0, 1.0)
    if max_repeats is not None:
        few = lambda x: all(budget * w <= max_repeats * live[s] * (1 + 1e-12) for s, w in weights_at(live, x).items())
        low = a if target_entropy is not None else 0.0
        a = low if few(low) else 1.0 if not few(1.0) else last(few, 1.0, low)
    return a


@dataclass(frozen=True)
class Plan:
    exponent: float
    budget: int
    tokens: dict[str, int]
    weights: dict[str, float]
    budgets: dict[str, int]


def plan_mix(totals: DataFrame, budget: int | None = None, **target) -> Plan:
    """From (source, tokens), one row per source. The number of sources is what the driver sees, never their rows."""
    tokens = {r["source"]: int(r["tokens"]) for r in sorted(totals.collect(), key=lambda r: r["source"])}
    total = sum(tokens.values())
    budget = total if budget is None else budget
    if not total:
        return Plan(1.0, budget, tokens, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 0))
    a = bisect_exponent(tokens, budget=budget, **target)
    w = weights_at(tokens, a)
    return Plan(a, budget, tokens, w, {s: round(budget * x) for s, x in w.items()})


def n_tokens(text: str = "text") -> Column:
    """Words between runs of ASCII white space, counted in the JVM; null or blank: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Sources up to which their table is broadcast.
MOST_SOURCES = 500_000


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with the copies it gets: (key, source, tokens, weight, exponent, block, start, copies, *keep).

    A source of T tokens and budget B gets floor(B/T) whole passes, plus the documents of its permutation whose
    ``start`` (tokens before them in it) lies before the rest, B mod T: a source takes less than one document more than
    its budget. The permutation is the order of a seeded md5 of the key, ties by text hash. Its first 12 bits are the
    block, the next 12 the sub-block: sums run over blocks (4096 a source), then inside the one block where the budget
    ends, and then inside its one sub-block, so no task holds a source. ``start`` is null for documents of other
    sub-blocks, which are wholly in or out.

    A null source counts as the source ''; null or blank text has 0 tokens, and passes as its place in the order says;
    a repeated row takes its place twice; an empty table gives no rows.
    """
    md = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = docs.select(F.col(key), F.coalesce(F.col(source), F.lit("")).alias("source"), n_tokens(text).alias("tokens"), F.conv(F.substring(md, 1, 12), 16, 10).cast("long").alias("_h"), F.xxhash64(text).alias("_t"), *[F.col(c) for c in keep if c not in (key, source)])
    # first 12 of the 48 bits, the next 12
    rows = rows.withColumn("block", F.shiftright("_h", 36).cast("int")).withColumn("_sub", (F.shiftright("_h", 24) % 4096).cast("int"))
    spark = docs.sparkSession
    if not keep:
        rows = cut(rows)  # a few numbers a document, so that texts are read once
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("tokens").alias("n")))
    made = plan_mix(blocks.groupBy("source").agg(F.sum("n").alias("tokens")), budget, target_entropy=target_entropy, max_repeats=max_repeats)
    table = [(s, made.weights[s], made.budgets[s] // n if n else 0, made.budgets[s] % n if n else 0) for s, n in made.tokens.items()]
    per = spark.createDataFrame(table, "source string, weight double, passes long, rest long")
    # a row a source: broadcast up to a checked number of sources, else Spark joins by shuffle
    spread = F.broadcast if len(table) <= MOST_SOURCES else lambda df: df
    before = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda order: F.coalesce(F.sum("n").over(before.orderBy(order)), F.lit(0))
    # which block of each source holds the end of its budget; blocks before it are in
    edges = blocks.withColumn("b0", ahead("block")).join(spread(per), "source").where("b0 < rest").groupBy("source").agg(F.max(F.struct("block", "b0")).alias("e"))
    edges = edges.select("source", F.col("e.block").alias("e_block"), F.col("e.b0").alias("e_b0"))
    per = per.join(edges, "source", "left")
    subs = rows.join(spread(per), "source").where("block = e_block").groupBy("source", "_sub").agg(F.sum("tokens").alias("n"), F.max("e_b0").alias("e_b0"), F.max("rest").alias("rest"))
    subs = subs.withColumn("s0", F.col("e_b0") + ahead("_sub")).where("s0 < rest").groupBy("source").agg(F.max(F.struct("_sub", "s0")).alias("s"))
    per = per.join(subs.select("source", F.col("s._sub").alias("e_sub"), F.col("s.s0").alias("e_s0")), "source", "left")
    rows = rows.join(spread(per), "source")
    last = (F.col("block") == F.col("e_block")) & (F.col("_sub") == F.col("e_sub"))
    inside = Window.partitionBy("source", "_cell").orderBy("_h", "_t").rowsBetween(Window.unboundedPreceding, -1)
    # rows of the last sub-block share a cell; the others are spread, and need no order
    fine = rows.where(last).withColumn("_cell", F.lit(0)).withColumn("start", F.col("e_s0") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("_cell")
    coarse = rows.where(~F.coalesce(last, F.lit(False))).withColumn("start", F.lit(None).cast("long"))
    early = F.when(F.col("start").isNotNull(), F.col("start") < F.col("rest")).otherwise((F.col("block") < F.col("e_block")) | ((F.col("block") == F.col("e_block")) & (F.col("_sub") < F.col("e_sub"))))
    copies = (F.col("passes") + F.coalesce(early, F.lit(False)).cast("int")).cast("int")
    return fine.unionByName(coarse).select(key, "source", "tokens", "weight", F.lit(made.exponent).alias("exponent"), "block", "start", copies.alias("copies"), *[c for c in keep if c not in (key, source)])


def op4_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to 95 % of the largest entropy, at most 4 passes of a source."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def realise(docs: DataFrame, seed: int = 17, **target) -> DataFrame:
    """The rows of ``docs``, each as often as the mix asks (see ``mix``); columns and their values as they were, whatever
    their names. A null source counts as one of its own name, ''; rows of null or blank text weigh nothing and pass as their
    place says; repeated rows take a place each; an empty table gives no rows."""
    packed = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    mixed = mix(packed, seed=seed, keep=("_row",), **target).where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
