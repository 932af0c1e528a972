"""Topics, summaries by category, running summaries, and the choice of a compression strategy by budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.functions import text as tx
from tarnfold.operators import conversation as cv


def topics(rows: DataFrame, by: list[str], category: str = "category", tags: str = "tags", most: int = 10) -> DataFrame:
    """(by, topics): the first ``most`` in order of distinct categories and tags. Sets are merged before the shuffle, and no
    more than ``most`` are ever listed."""
    each = rows.select(*by, F.explode(F.array_compact(F.concat(F.array(category), F.coalesce(tags, F.array().cast("array<string>"))))).alias("t")).distinct()
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("t"))).where(F.col("_n") <= most)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list("t")).alias("topics"))


def by_category(rows: DataFrame, category: str, text: str, n: int = 2, key: str = "doc_id") -> DataFrame:
    """(category, rank, key, sentence): an extractive summary a category; null is 'uncategorized'. It is also what stands for
    an abstractive summary where no model is at hand."""
    return cv.extractive_summary(rows.select(F.coalesce(category, F.lit("uncategorized")).alias("category"), key, text), key, text, n, "category")


def running_summary(existing: DataFrame, new: DataFrame, key: str, order: str, text: str, n: int = 3) -> DataFrame:
    """(key, summary, sources) after a batch: the sentences of the summary so far and of the new texts, in this order, are
    summed up again to the best ``n``, kept in their order. ``existing`` has (key, summary, sources); keys without new
    texts stay as they are, new keys start."""
    parts = lambda t: F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")
    told = new.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("m")).select(key, F.flatten(F.transform("m", lambda x: parts(F.coalesce(x[text], F.lit(""))))).alias("new"), F.size("m").alias("k"))
    rows = existing.join(told, key, "full_outer")
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce(parts(F.col("summary")), none), F.coalesce("new", none))
    best = best_sentences(every, n)
    return rows.select(key, F.when(F.col("k").isNull(), F.col("summary")).otherwise(F.array_join(best, " ")).alias("summary"), (F.coalesce("sources", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("sources"))


def best_sentences(sentences: Column, n: int) -> Column:
    """The ``n`` best by early position and a word count of 4 to 50, in their order."""
    count = F.size(sentences)

    def scored(s: Column, i: Column) -> Column:
        words = F.regexp_count(s, F.lit(r"\S+"))
        return F.struct((-(1 - 0.5 * i / count) * F.when(words > 50, 0.8).when(words < 4, 0.5).otherwise(1.0)).alias("score"), i.alias("i"), s.alias("s"))

    first = F.slice(F.array_sort(F.transform(sentences, scored)), 1, n)
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])


# Patterns that make a sentence matter, and how much. Names of two words are looked for, as longer ones hold
# such a pair; a repeated group would take a stack frame a word on long texts.
MATTERS = (
    (r"\b(?:important|critical|key|essential|must|should)\b", 2.0),
    (r"\b(?:decided|concluded|determined|agreed|resolved)\b", 1.8),
    (r"\b(?:because|therefore|thus|hence|consequently)\b", 1.5),
    (r"\b(?:first|finally|in summary|to summarize)\b", 1.5),
    (r"\b(?:\d{4}[-/]\d{2}[-/]\d{2})\b", 1.3),
    (r"\b(?:\$\d+|\d+%)\b", 1.3),
    (r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", 1.2),
)
#: Sentences by level of detail.
LEVELS = {"brief": 2, "standard": 5, "detailed": 10}


def weighted_summary(rows: DataFrame, by: list[str], text: str, order: str, importance: Column, level: str = "standard", least: int = 20) -> DataFrame:
    """(by, rank, sentence, score): sentences after . ! or ? of at least ``least`` characters, by 1 + 0.5 in a text's first
    fifth (0.3 in its last), times the weights of MATTERS, 0.8 over 50 words, and 0.5 + importance; best first, ties in the
    order of the texts."""
    s = rows.select(*by, order, importance.alias("_imp"), tx.sentences_after_marks(F.col(text), least).alias("_s"))
    s = s.select(*by, order, "_imp", F.size("_s").alias("_n"), F.posexplode("_s").alias("pos", "sentence"))
    at = F.col("pos") / F.col("_n")
    score = 1 + F.when(at < 0.2, 0.5).when(at > 0.8, 0.3).otherwise(0.0)
    for p, w in MATTERS:
        score = score * F.when(F.regexp_like("sentence", F.lit("(?i)" + p)), w).otherwise(1.0)
    score = score * F.when(F.regexp_count("sentence", F.lit(r"\S+")) > 50, 0.8).otherwise(1.0) * (0.5 + F.col("_imp"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), order, "pos")
    return s.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= LEVELS[level]).select(*by, "rank", "sentence", "score")


STRATEGIES = ("truncate", "summarize", "key_facts", "tiered")


def compressed(messages: DataFrame, strategy: str, budget: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, content) that a strategy keeps; messages of critical lines are kept whole by all."""
    content = F.col(text).alias("content")
    if strategy == "truncate":
        out = messages.join(cv.truncate(messages, budget, conv=conv, turn=turn, role=role, text=text).select(conv, turn), [conv, turn], "left_semi").select(conv, turn, content)
    elif strategy == "summarize":
        recent = cv.tiers(messages, 2, 0, conv, turn, role)
        whole = recent.where("tier <> 'old'").select(conv, turn, content)
        out = whole.unionByName(recent.where("tier = 'old'").select(conv, turn, cv.first_sentence(F.col(text)).alias("content")).where("content is not null"))
    elif strategy == "key_facts":
        facts = cv.key_facts(messages, conv=conv, turn=turn, text=text).groupBy(conv, turn).agg(F.array_join(F.array_sort(F.collect_list("fact")), "; ").alias("content"))
        system = messages.where(F.col(role) == "system").select(conv, turn, content)
        out = system.unionByName(facts.join(system.select(conv, turn), [conv, turn], "left_anti"))
    else:
        out = cv.tiered(messages, conv=conv, turn=turn, role=role, text=text).select(conv, turn, "content")
    critical = messages.where(F.contains(F.lower(text), F.lit("[critical]"))).select(conv, turn, content)
    return out.join(critical.select(conv, turn), [conv, turn], "left_anti").unionByName(critical)


def auto_strategy(messages: DataFrame, budget: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, strategy, tokens_before, tokens): 'none' within the budget; else the first of STRATEGIES that gets there, or the
    last one's best effort."""
    out = messages.groupBy(conv).agg(F.sum(cv.n_tokens(F.col(text))).alias("tokens_before"))
    for s in STRATEGIES:
        got = compressed(messages, s, budget, conv, turn, role, text).groupBy(conv).agg(F.sum(cv.n_tokens(F.col("content"))).alias(f"_{s}"))
        out = out.join(got, conv, "left").withColumn(f"_{s}", F.coalesce(f"_{s}", F.lit(0)))
    within = F.col("tokens_before") <= budget
    chosen, tokens = F.when(within, "none"), F.when(within, F.col("tokens_before"))
    for s in STRATEGIES[:-1]:
        chosen, tokens = chosen.when(F.col(f"_{s}") <= budget, s), tokens.when(F.col(f"_{s}") <= budget, F.col(f"_{s}"))
    return out.select(conv, chosen.otherwise(STRATEGIES[-1]).alias("strategy"), "tokens_before", tokens.otherwise(F.col(f"_{STRATEGIES[-1]}")).alias("tokens"))
