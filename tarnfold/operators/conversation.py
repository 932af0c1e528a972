"""Token-budgeted conversation operators: importance, candidates, truncation, key facts and extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.functions import rules as rl
from tarnfold.functions import text as tx


def n_tokens(text: Column) -> Column:
    """Words and single marks: an offline stand-in for a model's tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")), F.lit(0))


def importance(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages with ``importance`` in 0..1: position, role and pattern features by weight."""
    w = Window.partitionBy(conv)
    i, n = F.row_number().over(w.orderBy(turn)) - 1, F.count("*").over(w)
    rows = messages.withColumns({"_i": i, "_n": n})
    recency = F.when(F.col("_n") == 1, 1.0).otherwise(F.col("_i") / (F.col("_n") - 1))
    on = lambda name, test: F.when(test, rl.IMPORTANCE[name]).otherwise(0.0)
    score = recency * rl.IMPORTANCE["recency"] + on("is_first_message", F.col("_i") == 0) + on("is_last_exchange", F.col("_i") >= F.col("_n") - 2) + on("is_system", F.col(role) == "system")
    for name, pattern in rl.FEATURES:
        score = score + on(name, F.coalesce(F.col(text).rlike(pattern), F.lit(False)))
    return rows.withColumn("importance", F.least(F.lit(1.0), score)).drop("_i", "_n")


def compression_candidates(scored: DataFrame, share: float = 0.5, recent: int = 2, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The least important floor(n * share) messages, system and the most recent ones aside."""
    w = Window.partitionBy(conv)
    rows = scored.withColumns({"_back": F.row_number().over(w.orderBy(F.desc(turn))), "_n": F.count("*").over(w)})
    able = rows.where((F.col(role) != "system") & (F.col("_back") > recent))
    order = F.row_number().over(w.orderBy("importance", turn))
    return able.withColumn("_r", order).where(F.col("_r") <= F.floor(F.col("_n") * share)).drop("_back", "_n", "_r")


def stats(scored: DataFrame, budget: int, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    t = n_tokens(F.col(text))
    return scored.groupBy(conv).agg(F.count("*").alias("messages"), F.sum(t).alias("tokens"), (F.sum(t) > budget).alias("over"), F.sum(F.when(F.col(role) == "system", t).otherwise(0)).alias("system_tokens"), F.avg("importance").alias("avg_importance"))


def truncate(messages: DataFrame, budget: int, recent: int = 2, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages kept, oldest to newest: system and recent ones always; another if what is kept so far, itself and all
    later preserved ones fit the budget. A fold over one conversation's ordered structs."""
    w = Window.partitionBy(conv)
    rows = messages.select(conv, turn, n_tokens(F.col(text)).alias("_t"), ((F.col(role) == "system") | (F.row_number().over(w.orderBy(F.desc(turn))) <= recent)).alias("_p"))
    per = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col("_t").alias("t"), F.col("_p").alias("p")))).alias("m"))
    later = F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.when(x["p"], x["t"]).otherwise(0))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.col("later").alias("left"), F.array().cast("array<bigint>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        left = s["left"] - F.when(x["p"], x["t"]).otherwise(0)
        keep = x["p"] | (s["used"] + x["t"] + left <= budget)
        return F.struct((s["used"] + F.when(keep, x["t"]).otherwise(0)).alias("used"), left.alias("left"), F.when(keep, F.concat(s["kept"], F.array(x["turn"].cast("bigint")))).otherwise(s["kept"]).alias("kept"))

    out = per.withColumn("later", later).select(conv, F.aggregate("m", start, step).alias("s"))
    return out.select(conv, F.explode("s.kept").alias(turn), F.col("s.used").alias("tokens"))


def extractive_summary(rows: DataFrame, key: str, text: str, n: int = 2, group: str | None = None) -> DataFrame:
    """(key, rank, sentence), or with ``group`` (group, rank, key, sentence): the best n sentences of each text, or of all
    texts of a group, by word count within 4 to 50 and early position in their own text; ties by key, then position. Only n
    rows a task and group are shuffled."""
    by = key if group is None else group
    s = rows.select(*([group] if group else []), key, tx.sentences(F.col(text)).alias("s"))
    s = s.select(*([group] if group else []), key, F.size("s").alias("count"), F.posexplode("s").alias("pos", "sentence"))
    words = F.regexp_count("sentence", F.lit(r"\S+"))
    s = s.withColumn("score", F.round((1 - 0.5 * F.col("pos") / F.col("count")) * F.when(words > 50, 0.8).when(words < 4, 0.5).otherwise(1.0), 12))
    best = s.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key, "pos"))).where(F.col("rank") <= n)
    return best.select(key, "rank", "sentence") if group is None else best.select(group, "rank", key, "sentence")


def key_facts(messages: DataFrame, most: int = 3, conv: str = "conv_id", turn: str = "turn", text: str = "text", rules=rl.KEY_FACTS) -> DataFrame:
    """(conv, turn, kind, fact): at most ``most`` a message, in rule order, of more than 5 characters, cut at 100."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.col(text), F.lit("(?i)" + p), F.lit(1)), _tagged(kind)) for p, kind in rules]))
    long = F.slice(F.filter(found, lambda f: F.length(f["fact"]) > 5), 1, most)
    return messages.select(conv, turn, F.explode(long).alias("f")).select(conv, turn, "f.kind", F.substring("f.fact", 1, 100).alias("fact"))


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("fact"))


def tiers(messages: DataFrame, recent: int = 4, medium: int = 8, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Messages with ``tier``: system, recent (the last ones), medium (before them) or old."""
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    return messages.withColumn("_b", back).withColumn("tier", F.when(F.col(role) == "system", "system").when(F.col("_b") <= recent, "recent").when(F.col("_b") <= recent + medium, "medium").otherwise("old")).drop("_b")


def first_sentence(text: Column, least: int = 20, most: int = 100) -> Column:
    """The first sentence of more than ``least`` characters, cut at ``most``; null without one."""
    return F.substring(F.get(F.filter(tx.sentences(text), lambda s: F.length(s) > least), F.lit(0)), 1, most)


def tiered(messages: DataFrame, recent: int = 4, medium: int = 8, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, tier, content): system and recent messages whole, medium ones by their first sentence, old ones by
    their key facts; messages that leave nothing go."""
    t = tiers(messages, recent, medium, conv, turn, role)
    whole = t.where(F.col("tier").isin("system", "recent")).select(conv, turn, "tier", F.col(text).alias("content"))
    short = t.where("tier = 'medium'").select(conv, turn, "tier", first_sentence(F.col(text)).alias("content")).where("content is not null")
    facts = key_facts(t.where("tier = 'old'"), conv=conv, turn=turn, text=text).groupBy(conv, turn).agg(F.array_join(F.array_sort(F.collect_list("fact")), "; ").alias("content"))
    return whole.unionByName(short).unionByName(facts.select(conv, turn, F.lit("old").alias("tier"), "content"))


def hierarchy(rows: DataFrame, group: str, order: str, text: str, size: int = 5) -> DataFrame:
    """(group, chunk, level, summary): first sentences of chunks of ``size`` rows (level 1), and of the chunks (level 0,
    chunk -1)."""
    chunked = rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(first_sentence(F.col(text)), F.substring(text, 1, 100)).alias("s")))), lambda x: x["s"]), " ")
    leaf = chunked.groupBy(group, "chunk").agg(part.alias("summary"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.substring("summary", 1, 100).alias("s")))), lambda x: x["s"]), " ")
    root = leaf.groupBy(group).agg(top.alias("summary")).select(group, F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("level"), "summary")
    return leaf.select(group, "chunk", F.lit(1).alias("level"), "summary").unionByName(root)


def tiered_budget(messages: DataFrame, budget: int, recent: int = 4, medium: int = 8, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, tier, content, tokens): a conversation within ``budget`` tokens, never above.

    One that fits as it is stays whole (tier 'whole'). Else, step by step: system messages from the first on; recent ones
    from the last back, in what that leaves; of old messages their key facts, from the first on, in a quarter of the budget
    at most; of medium ones their first sentence, in a third and what the old ones left of their quarter at most. Each step
    takes messages until one does not fit what is left for it: the final cut is the prefix sums' own. All in windows over a
    conversation, which Spark sorts and spills; no list of messages is made.
    """
    w = Window.partitionBy(conv)
    sized = tiers(messages.withColumn("_n", n_tokens(F.col(text))), recent, medium, conv, turn, role).withColumn("_all", F.sum("_n").over(w))
    fits = sized.where(F.col("_all") <= budget).select(conv, turn, F.lit("whole").alias("tier"), F.col(text).alias("content"), F.col("_n").alias("tokens"))
    over = sized.where(F.col("_all") > budget).select(conv, turn, role, text, "tier")
    whole = over.where(F.col("tier").isin("system", "recent")).select(conv, turn, "tier", F.col(text).alias("content"))
    short = over.where("tier = 'medium'").select(conv, turn, "tier", first_sentence(F.col(text)).alias("content"))
    facts = key_facts(over.where("tier = 'old'"), conv=conv, turn=turn, text=text).groupBy(conv, turn).agg(F.array_join(F.array_sort(F.collect_list("fact")), "; ").alias("content"))  # three a message
    rows = whole.unionByName(short).unionByName(facts.select(conv, turn, F.lit("old").alias("tier"), "content")).where("content is not null").withColumn("tokens", n_tokens(F.col("content")))
    place = F.when(F.col("tier") == "recent", -F.col(turn)).otherwise(F.col(turn))
    mine = Window.partitionBy(conv, "tier").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", place).withColumn("_upto", F.sum("tokens").over(mine))

    def used(tier: str, share: Column) -> Column:
        """Tokens that a tier takes of its share: the last prefix sum within it."""
        return F.coalesce(F.max(F.when((F.col("tier") == tier) & (F.col("_upto") <= share), F.col("_upto"))).over(w), F.lit(0))

    left = F.lit(budget)
    for tier, share in (("system", None), ("recent", None), ("old", budget // 4), ("medium", budget // 3)):
        if tier == "medium":
            room = F.least(F.col("_left"), F.lit(share) + F.lit(budget // 4) - F.col("_used_old"))
        else:
            room = left if share is None and tier == "system" else F.col("_left") if share is None else F.least(F.col("_left"), F.lit(share))
        rows = rows.withColumn(f"_room_{tier}", room).withColumn(f"_used_{tier}", used(tier, F.col(f"_room_{tier}")))
        rows = rows.withColumn("_left", (left if tier == "system" else F.col("_left")) - F.col(f"_used_{tier}"))
    kept = F.coalesce(*[F.when(F.col("tier") == t, F.col("_upto") <= F.col(f"_room_{t}")) for t in ("system", "recent", "old", "medium")])
    return fits.unionByName(rows.where(kept).select(conv, turn, "tier", "content", "tokens"))
