"""Text expressions: tokens, sets, hashes, sentences and simple content heuristics. All are JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def word_set(text: Column) -> Column:
    """Distinct lower-cased runs between white space."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fact_similarity(key_a: Column, value_a: Column, key_b: Column, value_b: Column) -> Column:
    """0.3 of the keys' word overlap and 0.7 of the values'."""
    return 0.3 * jaccard(word_set(key_a), word_set(key_b)) + 0.7 * jaccard(word_set(value_a), word_set(value_b))


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+", " ")


def content_hash(text: Column, collapse: bool = True) -> Column:
    """sha256 of the lower-cased, stripped text, inner white space collapsed or kept."""
    return F.sha2(normalized(text) if collapse else F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), 256)


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of sha256 of the parts joined by ':'."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def shard(key: Column, n: int) -> Column:
    """md5 of the key, as a number, modulo n (a power of two up to 2^48)."""
    return (F.conv(F.substring(F.md5(key), -12, 12), 16, 10).cast("long") % n).cast("int")


def sentences(text: Column) -> Column:
    """Stripped, non-empty pieces between runs of . ! ?"""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def special_ratio(text: Column) -> Column:
    """Share of characters that are no letter, digit or white space; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.length(text))


def repetition(text: Column) -> Column:
    """Distinct over all words; 1 for an empty text."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))
    return F.when(F.size(w) == 0, 1.0).otherwise(F.size(F.array_distinct(w)) / F.size(w))


def sentences_after_marks(text: Column, least: int = 20) -> Column:
    """Pieces between white space that follows . ! or ?, marks kept, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= least)


def with_context(text: Column, mention: Column, window: int = 50) -> Column:
    """The first place of a mention with ``window`` characters on either side; null where it is absent."""
    at = F.instr(text, mention)
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + F.length(mention) + window - start))
