"""Licence scans by a positional rare-token index, in DataFrame functions alone.

A file's licence words are looked up. Each template's highest-IDF words are its anchors: so many that a placement without
any of them has too few of the template's words to be accepted. An anchor in a file nominates placements of its
templates (file position minus template position). A nominated placement's mandatory key phrases, version numbers among
them, are verified word by word where the template has them, and it is held against all licence words of its template.
Exact phrases are templates whose every word is mandatory, found from their rarest word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII but digits and letters: between words.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...]


# Usual notices of public licences, and the phrases without which a text is not such a notice.
TEMPLATES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0-1.0", "this work is dedicated to the public domain under cc0 1 0 universal", ("cc0",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("zlib", "this software is provided as is without any express or implied warranty", ("without any express or implied warranty",)),
)
# Function words that are no licence words.
STOP = frozenset("a an and any are as at be by for from in into is of on or that the this to under use with without all 0 1 2 3 4 v".split())


def words(text: Column) -> Column:
    """A-Z lower-cased; words between runs of the ASCII characters that are neither digits nor letters. No word: empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS)), " "), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def licence_words(phrases: dict[str, str], templates: tuple[Template, ...]) -> list[str]:
    """The index's vocabulary: bounded by the templates, whatever the corpus."""
    found = {w for t in templates for w in t.text.split()} | {w for p in phrases for w in p.split()}
    return sorted(found - STOP)


def idf(rows: DataFrame, vocabulary: list[str], column: str = "_w") -> dict[str, float]:
    """ln((N + 1) / (df + 1)) of each licence word over all rows: one partial aggregate, one row a licence word."""
    hits = rows.select(F.explode(F.array_intersect(column, _strings(vocabulary))).alias("w"))
    # the row that counts documents has no word
    every = rows.select(F.lit(None).cast("string").alias("w")).unionByName(hits)
    got = {r["w"]: r["n"] for r in every.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = got.pop(None, 0)
    return {w: math.log((n + 1) / (got.get(w, 0) + 1)) for w in vocabulary}


def _phrase_at(w: Column, start: Column, phrase: list[str]) -> Column:
    test = start >= 0
    for k, x in enumerate(phrase):
        test = test & F.coalesce(F.get(w, start + k) == x, F.lit(False))
    return test


def key_words(template: Template) -> list[tuple[int, str]]:
    """(place, word) of the template's key phrases: all of them have to stand where the template has them, digits too."""
    own, found = template.text.split(), set()
    for phrase in template.key_phrases:
        p = phrase.split()
        start = next(i for i in range(len(own)) if own[i : i + len(p)] == p)
        found |= {(start + k, x) for k, x in enumerate(p)}
    return sorted(found)


def _is(t: int):
    return lambda b: b["t"] == t


def _places(w: Column, at: Column, phrase: list[str], rare: int) -> Column:
    """Starts of a phrase: where its rarest word stands at its offset and all others stand in place."""
    return F.transform(F.filter(at, lambda i: (F.get(w, i) == phrase[rare]) & _phrase_at(w, i - rare, phrase)), lambda i: i - rare)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), phrases: dict[str, str] | None = None, templates: tuple[Template, ...] = TEMPLATES, least: float = 0.75) -> DataFrame:
    """Each row with n_words, n_base, first_word, last_word, base_labels, labels, score and templates (label, placed,
    of: the template's licence words in place, out of those that the row has anywhere).

    No shuffle: the corpus pass for IDF is an aggregate to the size of the vocabulary, and the scan is a projection. Null
    and empty texts have no words and no labels; repeated rows come back each; ties between words of equal IDF go to
    the word first in order; an empty table gives no rows; other columns are dropped unless named in ``keep``.
    """
    phrases = PHRASES if phrases is None else phrases
    vocabulary = licence_words(phrases, templates)
    rows = docs.select(*keep, words(F.col(text)).alias("_w"))
    weight = idf(rows, vocabulary)
    by_idf = sorted(vocabulary, key=lambda w: (-weight[w], w))
    rank = {w: i for i, w in enumerate(by_idf)}

    w = F.col("_w")
    has = F.size(F.array_intersect(w, _strings(vocabulary))) > 0
    # positions of licence words, for the rows that have any; others skip all that follows
    none = F.array().cast("array<int>")
    at = F.when(has, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(vocabulary))).otherwise(none)
    rows = rows.withColumn("_at", at)
    at = F.col("_at")

    # exact phrases: from their rarest word, by relative position
    starts = []
    for phrase in phrases:
        p = phrase.split()
        starts.append(_places(w, at, p, min((k for k, x in enumerate(p) if x in rank), key=lambda k: rank[p[k]])))
    rows = rows.withColumn("_base", F.array(*starts))

    # templates: of n words with `need` in place, one is among any n - need + 1, so the rarest of these nominate all
    own = [[(k, x) for k, x in enumerate(template.text.split()) if x in rank] for template in templates]
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, ws in enumerate(own):
        need = next((g for g in range(1, len(ws) + 1) if g >= least * len(ws)), None)
        for k, x in sorted(ws, key=lambda kx: (rank[kx[1]], kx[0]))[: 0 if need is None else len(ws) - need + 1]:
            postings.setdefault(x, []).append((t, k))
    index = F.create_map(*[c for x, ps in sorted(postings.items()) for c in (F.lit(x), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in ps]))])
    # an anchor at i and its posting at k of t: t may stand from i - k
    points = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(at, lambda i: F.get(w, i).isin(sorted(postings))),
                lambda i: F.transform(index[F.get(w, i)], lambda p: F.struct(p["t"].alias("t"), (i - p["k"]).alias("d"))),
            )
        )
    )
    listed = lambda ws: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in ws])
    every, musts = F.array(*[listed(ws) for ws in own]), F.array(*[listed(key_words(template)) for template in templates])
    zero = F.lit(0)
    # a place before the text's first word has none
    stands = lambda p, o: F.when(p["d"] + o["k"] >= 0, F.get(w, p["d"] + o["k"]) == o["x"])
    keyed = F.filter(points, lambda p: F.forall(F.get(musts, p["t"]), lambda o: F.coalesce(stands(p, o), F.lit(False))))
    placed = F.transform(keyed, lambda p: F.struct(p["t"].alias("t"), F.size(F.filter(F.get(every, p["t"]), lambda o: F.coalesce(stands(p, o), F.lit(False)))).alias("best")))
    rows = rows.withColumn("_best", F.when(F.size(at) > 0, placed).otherwise(F.array().cast("array<struct<t:int,best:int>>")))
    rows = rows.withColumn("_held", F.when(F.size("_best") > 0, F.array_intersect(w, _strings(vocabulary))))

    accepted = []
    for t, template in enumerate(templates):
        of = sum((F.array_contains(F.col("_held"), x).cast("int") for _, x in own[t]), zero)
        got = F.coalesce(F.array_max(F.transform(F.filter("_best", _is(t)), lambda b: b["best"])), zero)
        ok = (got >= 1) & (got >= least * len(own[t]))
        accepted.append(F.when(ok, F.struct(F.lit(template.label).alias("label"), got.alias("placed"), of.alias("of"))))
    found = F.when(F.size("_best") > 0, F.array_compact(F.array(*accepted))).otherwise(F.array().cast("array<struct<label:string,placed:int,of:int>>"))
    rows = rows.withColumn("templates", found)

    places = F.flatten("_base")
    labels = F.array_compact(F.array(*[F.when(F.size(F.get("_base", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    more = F.concat(labels, F.transform("templates", lambda x: x["label"]))
    sure = F.array_max(F.transform("templates", lambda x: F.least(F.lit(1.0), x["placed"] / F.greatest(x["of"], F.lit(1)))))
    return rows.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(more)), ",").alias("labels"),
        F.greatest(F.coalesce(sure, F.lit(0.0)), F.when(F.size(places) > 0, 1.0).otherwise(0.0)).cast("double").alias("score"),
        "templates",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("templates")
