"""A stored positional index over text columns, its query language, and top-k search that reads only a query's terms.

An index is a folder of Parquet tables: postings (term, class, key, column, length, count, positions) in the order of terms,
so that a term or a range of terms is a pushed filter that skips all other row groups; blocks (term, class) with the number of
documents and the largest weight; meta, one row. A class is a range of document lengths: documents of one class have
close bounds on what a term can weigh.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tarnfold.functions.stemming import stem
from tarnfold.session import cut, remove

#: Terms that are pushed as a list, and rows up to which a table of a query set is broadcast.
PUSHED_TERMS, BROADCAST_ROWS = 5_000, 500_000
#: Words that a worker turns into postings at once, postings a sorted file, documents of a batch that a worker gets.
WORDS, POSTINGS, BATCH = 200_000, 500_000, 500
#: Classes of document lengths for a doubling of the length.
CLASSES = 4
#: Queries of a block, documents of a part, and rows or terms of a tile, where a table of queries is scored. Scores are sums in
#: any order, rounded to 9 digits so that ties are ties.
QUERIES, DOCUMENTS, TILE = 256, 16_384, 2048


# ---------------------------------------------------------------- words


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Accented lower-case letters and the letters below the accents: every character whose decomposition is one letter and
    marks. Marks on their own are dropped."""
    pairs = []
    for i in range(0xC0, sys.maxunicode + 1):
        ch = chr(i)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and ch == ch.lower() and unicodedata.category(parts[0])[0] == "L" and all(unicodedata.combining(p) for p in parts[1:]) and i < 0x2000:
            pairs.append((ch, parts[0]))
    marks = [chr(i) for i in range(0x300, 0x370)]
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def _folding() -> dict[int, str | None]:
    old, new = _accents()
    return {ord(a): new[i] if i < len(new) else None for i, a in enumerate(old)}


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms. ``underscore`` makes it part of words; ``fold`` drops accents; ``porter`` stems."""

    underscore: bool = False
    fold: bool = True
    porter: bool = True

    def words(self, text: Column) -> Column:
        """JVM-side words before stemming; null gives none."""
        low = F.lower(text)
        return self.split(F.translate(low, *_accents()) if self.fold else low)

    def split(self, low: Column) -> Column:
        return F.coalesce(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+" if self.underscore else r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))

    def raw(self, text: Column) -> Column:
        """JVM-side words before accents are dropped, which ``term`` does once a distinct word: a letter stays one, so words end
        where they did."""
        low = F.lower(text)
        low = F.regexp_replace(low, "[\\u0300-\\u036f]+", "") if self.fold else low
        return self.split(low)

    def term(self, word: str) -> str:
        """What ``terms`` makes of one of the raw words."""
        word = word.translate(_folding()) if self.fold else word
        return stem(word) if self.porter else word

    def terms(self, text: str) -> list[str]:
        """The same of one string of a query."""
        low = text.lower()
        if self.fold:
            low = low.translate(_folding())
        kept = "".join(c if unicodedata.category(c)[0] in "LN" or (self.underscore and c == "_") else " " for c in low)
        return [stem(w) if self.porter else w for w in kept.split()]


PORTER, PLAIN = Analyzer(), Analyzer(underscore=True, fold=False, porter=False)


# ---------------------------------------------------------------- query language


@dataclass(frozen=True)
class Phrase:
    """Terms one behind the other; with ``prefix`` the last one is a prefix; ``columns`` None: any."""

    terms: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Node:
    """``and``, ``or`` or ``not`` (the first without the second) over phrases and nodes."""

    kind: str
    parts: tuple[Node | Phrase, ...] = field(default=())


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([():+*{}^-])|([^\s"():+*{}^-]+))')


def parse(query: str, analyzer: Analyzer = PORTER, columns: tuple[str, ...] = ()) -> Node | Phrase | None:
    """Words, "phrases", word* and "phrase wo"*, a + b for one phrase, AND, OR, NOT (upper case; NOT binds before AND, AND
    before OR, neighbours without an operator closest of all), brackets, ``column : x`` and ``{a b} : x``. Text without a
    word matches nothing and drops out; None where nothing is left. Other input is a ValueError."""
    items: list[tuple[str, str]] = []
    at = 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"not understood: {query[at:]!r}")
        quoted, mark, word = m.groups()
        items.append(("string", quoted.replace('""', '"')) if quoted is not None else ("mark", mark) if mark else ("op", word) if word in ("AND", "OR", "NOT") else ("string", word))
        at = m.end()
    place = 0

    def peek(n: int = 0) -> tuple[str, str] | tuple[None, None]:
        return items[place + n] if place + n < len(items) else (None, None)

    def take(kind: str | None = None, value: str | None = None) -> str:
        nonlocal place
        got = peek()
        if got[0] is None or (kind and got[0] != kind) or (value and got[1] != value):
            raise ValueError(f"expected {value or kind} at item {place + 1} of {query!r}")
        place += 1
        return got[1]

    def joined(kind: str, parts: list) -> Node | Phrase | None:
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

    def either(only):
        parts = [both(only)]
        while peek() == ("op", "OR"):
            take()
            parts.append(both(only))
        return joined("or", parts)

    def both(only):
        parts = [without(only)]
        while peek() == ("op", "AND"):
            take()
            parts.append(without(only))
        return joined("and", parts)

    def without(only):
        left = near(only)
        while peek() == ("op", "NOT"):
            take()
            right = near(only)
            left = left if right is None or left is None else Node("not", (left, right))
        return left

    def near(only):
        parts = [primary(only)]
        while peek()[0] == "string" or peek() in (("mark", "("), ("mark", "{")):
            parts.append(primary(only))
        return joined("and", parts)

    def primary(only):
        named: list[str] | None = None
        if peek() == ("mark", "{"):
            take()
            named = []
            while peek() != ("mark", "}"):
                named.append(take("string"))
            take()
        elif peek()[0] == "string" and peek(1) == ("mark", ":"):
            named = [take()]
        if named is not None:
            take("mark", ":")
            if not set(named) <= set(columns):
                raise ValueError(f"no such column: {sorted(set(named) - set(columns))}")
            return primary(tuple(named if only is None else [c for c in named if c in only]))
        if peek() == ("mark", "("):
            take()
            out = either(only)
            take("mark", ")")
            return out
        terms, prefix = list(analyzer.terms(take("string"))), False
        while peek() in (("mark", "+"), ("mark", "*")):
            if take() == "*":
                prefix = True
                break
            terms += analyzer.terms(take("string"))
        return Phrase(tuple(terms), prefix, only) if terms else None

    out = either(None) if items else None
    if place != len(items):
        raise ValueError(f"not understood: item {place + 1} of {query!r}")
    return out


def phrases(tree: Node | Phrase | None) -> list[Phrase]:
    """A tree's phrases, left to right, each once."""
    found = [] if tree is None else [tree] if isinstance(tree, Phrase) else [p for part in tree.parts for p in phrases(part)]
    return list(dict.fromkeys(found))


def condition(tree: Node | Phrase, has: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return has[tree]
    parts = [condition(p, has) for p in tree.parts]
    if tree.kind == "not":
        return parts[0] & ~parts[1]
    return reduce(Column.__and__ if tree.kind == "and" else Column.__or__, parts)


def counted(tree: Node | Phrase, has: dict[Phrase, Column], inside: Column | None = None) -> dict[Phrase, Column]:
    """Where each phrase counts for the score: in a part of the query that matches as a whole, and never behind NOT."""
    here = condition(tree, has) if inside is None else inside & condition(tree, has)
    if isinstance(tree, Phrase):
        return {tree: here}
    out: dict[Phrase, Column] = {}
    for part in tree.parts[:1] if tree.kind == "not" else tree.parts:
        for p, c in counted(part, has, here).items():
            out[p] = out[p] | c if p in out else c
    return out


# ---------------------------------------------------------------- the stored index


def _pieces(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most WORDS words together, or one row: what a worker holds doesn't grow with the batch."""
    upto = np.cumsum(np.sum([batch[f"w{i}"].value_lengths().to_numpy() for i in range(n)], axis=0))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + WORDS, "right")))
        yield batch.slice(start, end - start)
        start = end


def _summed(made: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of one piece's columns, ``row`` replaced by ``all``: a document's count of a term in all columns, at the
    first column that has it, 0 at the others."""
    if len(made) < 2:
        yield from (m.drop_columns("row").append_column("all", m["tf"]) for m in made)
        return
    term = pa.concat_arrays([m["term"] for m in made]).dictionary_encode().indices.to_numpy().astype(np.int64)
    same = np.concatenate([m["row"].to_numpy() for m in made]) * (term.max() + 1) + term
    _, first, group = np.unique(same, return_index=True, return_inverse=True)
    every = np.zeros(len(same), np.int32)
    every[first] = np.bincount(group, weights=np.concatenate([m["tf"].to_numpy() for m in made]))
    at = 0
    for m in made:
        yield m.drop_columns("row").append_column("all", pa.array(every[at : at + len(m)]))
        at += len(m)


def _postings(analyzer: Analyzer, n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in _pieces(whole, n)):
            lengths = [b[f"w{i}"].value_lengths().to_numpy() for i in range(n)]
            total = np.sum(lengths, axis=0).astype(np.int32)
            made = []
            for i in range(n):
                flat = b[f"w{i}"].flatten()
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                terms = coded.dictionary.to_pylist()
                terms, same = np.unique(np.array([analyzer.term(t) for t in terms], object), return_inverse=True)
                code = same[coded.indices.to_numpy()]
                row = np.repeat(np.arange(b.num_rows), lengths[i])
                place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths[i]) - lengths[i], lengths[i])
                order = np.argsort(row * len(terms) + code, kind="stable")
                whole = (row * len(terms) + code)[order]
                start = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
                offsets = np.append(start, len(order)).astype(np.int32)
                at = row[order][start]
                made.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array(terms[code[order][start]], pa.string()), b["key"].take(pa.array(at)), pa.array(np.full(len(at), i, np.int32)), pa.array(total[at]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order].astype(np.int32)))],
                        names=["term", "key", "col", "dl", "tf", "positions"],
                    ).append_column("row", pa.array(at))
                )
            yield from _summed(made)

    return work


def _class(dl: Column) -> Column:
    return F.floor(F.log2(F.greatest(dl, F.lit(1)).cast("double")) * CLASSES).cast("int")


@dataclass(frozen=True)
class Index:
    """Handle of a stored index: the folder and its one row of meta."""

    path: str
    analyzer: Analyzer
    columns: tuple[str, ...]
    n: int
    mean: float
    k1: float
    b: float

    def postings(self, spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
        rows = spark.read.parquet(f"{self.path}/postings")
        return rows if terms is None else rows.where(F.col("term").isin(terms))

    def blocks(self, spark: SparkSession) -> DataFrame:
        """(term, class, docs, top): documents that hold the term, and the largest weight of it in one of them, idf aside."""
        return spark.read.parquet(f"{self.path}/blocks")

    def terms(self, spark: SparkSession) -> DataFrame:
        """(term, df, cf): documents and occurrences."""
        return self.blocks(spark).groupBy("term").agg(F.sum("docs").alias("df"), F.sum("occurrences").alias("cf"))

    def weight(self, tf: Column, dl: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / F.lit(self.mean)))


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Workers get BATCH documents at a time, or a batch of long texts would fill them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def build(docs: DataFrame, path: str, columns: tuple[str, ...] = ("text",), key: str = "doc_id", analyzer: Analyzer = PORTER, k1: float = 1.2, b: float = 0.75) -> Index:
    """Writes the index of ``docs`` to ``path`` and opens it.

    Texts are read once, whole; what is shuffled is a row a document and term. A frequent term is dealt to many files, as
    order goes by term, class and key. Keys are unique; documents without a key are left out; null texts are empty and
    count as documents.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[analyzer.raw(F.col(c)).alias(f"w{i}") for i, c in enumerate(columns)])
    kind = docs.schema[key].dataType
    schema = StructType([StructField("term", StringType()), StructField("key", kind), *[StructField(c, IntegerType()) for c in ("col", "dl", "tf")], StructField("positions", ArrayType(IntegerType())), StructField("all", IntegerType())])
    made = f"{path}/unsorted"
    with few_rows(spark):
        rows.mapInArrow(_postings(analyzer, len(columns)), schema).withColumn("cls", _class(F.col("dl"))).write.parquet(made)
    dealt = spark.read.parquet(made)
    n = docs.where(F.col(key).isNotNull()).count()
    total = dealt.agg(F.sum("tf")).first()[0] or 0
    index = Index(path, analyzer, tuple(columns), n, total / n if n and total else 1.0, k1, b)
    dealt.drop("all").repartitionByRange(max(1, -(-dealt.count() // POSTINGS)), "term", "cls", "key").sortWithinPartitions("term", "cls", "key", "col").write.option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
    blocks = dealt.groupBy("term", "cls").agg(F.count_if(F.col("all") > 0).alias("docs"), F.sum("tf").alias("occurrences"), F.max(index.weight(F.col("all"), F.col("dl"))).alias("top"))
    blocks.repartitionByRange("term").sortWithinPartitions("term", "cls").write.parquet(f"{path}/blocks")
    meta = [(list(columns), analyzer.underscore, analyzer.fold, analyzer.porter, n, index.mean, k1, b)]
    remove(spark, made)
    spark.createDataFrame(meta, "columns array<string>, underscore boolean, fold boolean, porter boolean, n long, mean double, k1 double, b double").coalesce(1).write.parquet(f"{path}/meta")
    return index


def opened(spark: SparkSession, path: str) -> Index:
    m = spark.read.parquet(f"{path}/meta").first()
    return Index(path, Analyzer(m["underscore"], m["fold"], m["porter"]), tuple(m["columns"]), m["n"], m["mean"], m["k1"], m["b"])


# ---------------------------------------------------------------- one query


def _after(prefix: str) -> str:
    """The smallest string beyond all that start with ``prefix``."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < sys.maxunicode:
            return prefix[:i] + chr(ord(prefix[i]) + (0x801 if ord(prefix[i]) == 0xD7FF else 1))
    return prefix


def _range(prefix: str) -> Column:
    return (F.col("term") >= prefix) & (F.col("term") < _after(prefix))


def _counts(spark: SparkSession, index: Index, wanted: list[Phrase]) -> DataFrame:
    """occurrences of phrases of one word or prefix."""
    asked = [_range(p.terms[0]) if p.prefix else F.col("term") == p.terms[0] for p in wanted]
    here = [F.lit(True) if p.columns is None else F.col("col").isin([index.columns.index(c) for c in p.columns]) for p in wanted]
    rows = index.postings(spark).select("term", "key", "col", "dl", "tf").where(reduce(Column.__or__, asked))
    counts = [F.sum(F.when(a & h, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, (a, h) in enumerate(zip(asked, here))]
    return rows.groupBy("key").agg(F.max("dl").alias("dl"), *counts)


def occurrences(spark: SparkSession, index: Index, wanted: list[Phrase]) -> DataFrame:
    """(key, dl, f0, f1, ...): how often each document holds each phrase, for documents with one of their words.

    One scan by pushed term filters and one shuffle by key. A single word is a sum of counts, so its positions are never
    read. A phrase is the intersection of its words' positions, each shifted by its place, so no row a position is ever made.
    """
    if all(len(p.terms) == 1 for p in wanted):
        return _counts(spark, index, wanted)
    words = sorted({t for p in wanted for t in (p.terms[:-1] if p.prefix else p.terms)})
    starts = sorted({p.terms[-1] for p in wanted if p.prefix})
    asked = [F.col("term").isin(words)] if words else []
    rows = index.postings(spark).where(reduce(Column.__or__, asked + [_range(s) for s in starts]))
    one = lambda t: F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True)
    many = lambda s: F.flatten(F.collect_list(F.when(_range(s), F.col("positions"))))
    places = rows.repartition("key").groupBy("key", "col").agg(F.first("dl").alias("dl"), *[one(t).alias(f"w{i}") for i, t in enumerate(words)], *[many(s).alias(f"s{i}") for i, s in enumerate(starts)])

    def back(positions: Column, by: int) -> Column:
        return F.transform(positions, lambda x: x - by)

    def count(p: Phrase) -> Column:
        parts = [F.col(f"s{starts.index(t)}") if p.prefix and i == len(p.terms) - 1 else F.col(f"w{words.index(t)}") for i, t in enumerate(p.terms)]
        shifted = [back(c, i) if i else c for i, c in enumerate(parts)]
        found = F.coalesce(F.size(reduce(F.array_intersect, shifted)), F.lit(0)) if len(parts) > 1 else F.coalesce(F.size(parts[0]), F.lit(0))
        found = F.greatest(found, F.lit(0))  # size of null is -1 where legacy settings say so
        here = F.lit(True) if p.columns is None else F.col("col").isin([index.columns.index(c) for c in p.columns])
        return F.when(here, found).otherwise(0)

    return places.groupBy("key").agg(F.first("dl").alias("dl"), *[F.sum(count(p)).alias(f"f{i}") for i, p in enumerate(wanted)])


def search(spark: SparkSession, index: Index, query: str, k: int | None = 10, offset: int = 0, alive: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, score) of documents that a query matches, best first, ties to the smaller key; all of them where k is None.

    BM25 over phrases, each as a term of its own: idf = ln((N - df + 0.5) / (df + 0.5)), 0.000001 where that isn't positive.
    A phrase counts where the parts of the query around it match. Statistics hold for all documents of the index; ``alive`` (key) keeps a search to some of them.
    """
    tree = parse(query, index.analyzer, index.columns)
    empty = index.postings(spark).select(F.col("key").alias(key), F.lit(0.0).alias("score")).limit(0)
    if tree is None:
        return empty
    wanted = phrases(tree)
    rows = occurrences(spark, index, wanted)
    has = {p: F.col(f"f{i}") > 0 for i, p in enumerate(wanted)}
    df = rows.agg(*[F.count_if(has[p]).alias(f"d{i}") for i, p in enumerate(wanted)])
    score, where = F.lit(0.0), counted(tree, has)
    for i, p in enumerate(wanted):
        idf = F.log((F.lit(float(index.n)) - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        if p in where:
            score = score + F.when(where[p], F.when(idf > 0, idf).otherwise(1e-6) * index.weight(F.col(f"f{i}"), F.col("dl"))).otherwise(0.0)
    found = rows.where(condition(tree, has)).crossJoin(F.broadcast(df)).select(F.col("key").alias(key), score.alias("score"))  # one row of counts
    if alive is not None:
        found = found.join(alive.select(key).distinct(), key, "left_semi")
    return found if k is None else found.orderBy(F.desc("score"), key).offset(offset).limit(k)


# ---------------------------------------------------------------- many queries


def asked(queries: DataFrame, analyzer: Analyzer, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, times) of a table of query texts; texts are bags of words here, not the query language."""
    if analyzer.porter:
        raise ValueError("a table of queries is analysed in the JVM: index without stemming for it")
    words = queries.select(F.col(query).alias("query_id"), F.explode(analyzer.words(F.col(text))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class _Matrix:
    """A block of queries, and part after part of its documents: weights of terms by weights of queries."""

    def __init__(self, asked: pa.Table):
        ids, self.at = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
        self.ids, self.terms = pa.array(ids, asked.schema.field("query_id").type), asked["term"].combine_chunks().unique()
        self.term, self.idf = pa.compute.index_in(asked["term"], self.terms).to_numpy(), asked["idf"].to_numpy()

    def scores(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """Documents by queries; a tile of both matrices at a time is made whole."""
        out = np.zeros((n, len(self.ids)))
        for t in range(0, len(self.terms), TILE):
            mine = (self.term >= t) & (self.term < t + TILE)
            right = np.zeros((min(TILE, len(self.terms) - t), len(self.ids)))
            right[self.term[mine] - t, self.at[mine]] = self.idf[mine]
            here = np.flatnonzero((term >= t) & (term < t + TILE))
            here = here[np.argsort(doc[here], kind="stable")]
            upto = np.searchsorted(doc[here], np.arange(0, n + TILE, TILE))
            for i, d in enumerate(range(0, n, TILE)):
                at = here[upto[i] : upto[i + 1]]
                left = np.zeros((min(TILE, n - d), len(right)))
                left[doc[at] - d, term[at] - t] = w[at]
                out[d : d + TILE] += left @ right
        return out


def _met(k: int):
    def meet(postings: pa.Table, asked: pa.Table) -> pa.Table:
        """The k best documents of a part for each query of a block."""
        kind = postings.schema.field("key").type
        if not postings.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], asked.schema.field("query_id").type), "key": pa.array([], kind), "score": pa.array([], pa.float64())})
        block = _Matrix(asked)
        keys, doc = np.unique(postings["key"].to_numpy(), return_inverse=True)
        score = np.round(block.scores(doc, pa.compute.index_in(postings["term"], block.terms).to_numpy(), postings["w"].to_numpy(), len(keys)), 9)
        least = np.partition(score, len(keys) - k, axis=0)[len(keys) - k] if len(keys) > k else np.zeros(len(block.ids))
        row, query = np.nonzero((score > 0) & (score >= least))
        order = np.lexsort((row, -score[row, query], query))  # keys are in order
        row, query = row[order], query[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < k
        row, query = row[kept], query[kept]
        return pa.table({"query_id": block.ids.take(pa.array(query)), "key": pa.array(keys[row], kind), "score": score[row, query]})

    return meet


def batch_top_k(spark: SparkSession, index: Index, terms: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, key, score, rank) of a table (query_id, term, times): each query's k best documents by BM25 with
    idf = max(0.25, ln((N - df + 0.5) / (df + 0.5) + 1)), ties to the smaller key; documents without a term don't come.

    A posting of an asked term travels once a block of queries that asks it, to its document's part; there all queries of the
    block are scored by one product of matrices, and k rows a query leave. Every document with a term is scored in full.
    """
    terms = cut(terms)
    distinct = terms.select("term").distinct()
    few = [r["term"] for r in distinct.limit(PUSHED_TERMS + 1).collect()]
    listed, blocks = index.postings(spark, few if len(few) <= PUSHED_TERMS else None), index.blocks(spark)
    blocks = blocks.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else blocks.join(_small(distinct), "term", "left_semi")
    known = cut(blocks.groupBy("term").agg(F.sum("docs").alias("df")))
    idf = F.greatest(F.lit(0.25), F.log((F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    q_blocks = max(1, -(-terms.select("query_id").distinct().count() // QUERIES))
    per = cut(terms.join(known, "term").select(F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("q"), "query_id", "term", (idf * F.col("times")).alias("idf")))
    d_blocks = max(1, -(-(known.agg(F.sum("df")).first()[0] or 0) // POSTINGS), -(-index.n // DOCUMENTS))
    listed = listed.join(_small(per.select("q", "term").distinct()), "term")
    if len(index.columns) > 1:
        listed = listed.groupBy("q", "term", "key").agg(F.first("dl").alias("dl"), F.sum("tf").alias("tf"))
    left = listed.select(F.col("q").alias("b"), F.pmod(F.xxhash64("key"), F.lit(d_blocks)).alias("d"), "term", "key", index.weight(F.col("tf"), F.col("dl")).alias("w"))
    right = per.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(d_blocks - 1).cast("long"))))
    out = StructType([terms.schema["query_id"], StructField("key", left.schema["key"].dataType), StructField("score", DoubleType())])
    parts = left.groupBy("b", "d").cogroup(right.groupBy("q", "d")).applyInArrow(_met(k), out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "key", F.round("score", 9).alias("score"), "rank")


def batch_phrases(spark: SparkSession, index: Index, queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, key, times): documents that hold each query's words one behind the other, and how often.

    Postings of a query's rarest word nominate where the phrase could start; each other word is then looked up in these
    documents alone, by (term, key), so frequent words cost what the rare one left. Queries without a word match nothing.
    """
    analyzer = index.analyzer
    if analyzer.porter:
        raise ValueError("a table of queries is analysed in the JVM: index without stemming for it")
    words = cut(queries.select(F.col(query).alias("query_id"), F.posexplode(analyzer.words(F.col(text))).alias("at", "term")))
    df = index.blocks(spark).join(_small(words.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("df"))
    known = words.join(_small(df), "term", "left")
    rarest = known.groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "at")).alias("r"), F.count("*").alias("n"))
    rarest = rarest.where("r.df > 0").select("query_id", F.col("r.term").alias("term"), F.col("r.at").alias("at"), "n")
    rows = index.postings(spark).select("term", "key", "col", "positions")
    starts = rows.join(_small(rarest), "term").select("query_id", "key", "col", "n", F.explode("positions").alias("p"), "at").withColumn("start", F.col("p") - F.col("at")).where("start >= 0")
    starts = cut(starts.groupBy("query_id", "key", "col", "n").agg(F.collect_set("start").alias("starts")))  # within one document
    pairs = starts.select("query_id", "key", "col").join(_small(words.groupBy("query_id", "term").agg(F.collect_list("at").alias("ats"))), "query_id")
    found = rows.join(_small(pairs), ["term", "key", "col"]).select("query_id", "key", "col", F.explode("ats").alias("at"), "positions")
    held = found.join(starts, ["query_id", "key", "col"]).select("query_id", "key", "col", "n", F.explode(F.filter("starts", lambda s: F.array_contains("positions", s + F.col("at")))).alias("start"))
    whole = held.groupBy("query_id", "key", "col", "start").agg(F.count("*").alias("met"), F.first("n").alias("n")).where("met = n")
    return whole.groupBy("query_id", "key").agg(F.count("*").alias("times"))
