"""Injection risk, uncertainty, confidence and source checks of texts, as JVM-side expressions over rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfold.functions import rules as rl
from tarnfold.functions import text as tx


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("(?i)" + pattern)), F.lit(0))


def heuristics(text: Column) -> list[tuple[str, Column, float]]:
    """(name, triggered, risk): odd characters, length, nesting, repetition."""
    words = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
    nested = sum((F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))) / 3 for q in ('"""', "'''", "```"))
    return [
        ("special_characters", tx.special_ratio(text) > 0.3, 0.4),
        ("length", (F.length(text) > 5000) | (words > 500), 0.3),
        ("nesting", nested > 2, 0.5),
        ("repetition", (tx.repetition(text) < 0.3) & (words > 20), 0.4),
    ]


def risk(text: Column, rules=rl.RISKS, use_heuristics: bool = True) -> Column:
    """min(1, largest + 0.1 * (total - largest)) of weights times matches and of triggered heuristics."""
    hits = [(count(text, p), w) for p, _, _, w in rules]
    total = reduce(lambda a, b: a + b, [n * w for n, w in hits])
    most = F.greatest(*[F.when(n > 0, w).otherwise(0.0) for n, w in hits])
    if use_heuristics:
        extra = [F.when(on, r).otherwise(0.0) for _, on, r in heuristics(text)]
        total = total + reduce(lambda a, b: a + b, extra)
        most = F.greatest(most, *extra)
    return F.least(F.lit(1.0), most + 0.1 * (total - most))


def risk_kinds(text: Column, rules=rl.RISKS) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(count(text, p) > 0, kind) for p, _, kind, _ in rules]))))


def certainty(text: Column, rules=rl.UNCERTAINTY) -> Column:
    """1 minus the penalties, within 0 and 1."""
    parts = [F.when(count(text, p) >= least, F.least(F.lit(most), count(text, p) * each)).otherwise(0.0) for p, _, each, most, least in rules]
    return F.greatest(F.lit(0.0), F.lit(1.0) - reduce(lambda a, b: a + b, parts))


def should_defer(text: Column, threshold: float = 0.4) -> Column:
    explicit, speculative = (count(text, next(p for p, k, *_ in rl.UNCERTAINTY if k == kind)) > 0 for kind in ("explicit_uncertainty", "speculative"))
    c = certainty(text)
    return (c < threshold) | explicit | (speculative & (c < 0.6))


def confidence(text: Column, source: Column, days: Column, corroborating: Column) -> Column:
    """0.4 content + 0.3 source + 0.15 recency + 0.15 corroboration; recency 1 / (1 + days / 365)."""
    return 0.4 * certainty(text) + 0.3 * source + 0.15 * (1 / (1 + days / 365)) + 0.15 * F.least(F.lit(1.0), corroborating / 3)


def adjusted_for_source(base: Column, trust: Column) -> Column:
    return F.least(F.lit(1.0), F.when(trust >= 0.9, base * (1 + 0.2 * (trust - 0.9))).otherwise(base * trust))


def guard(text: Column, base: Column, trust: Column, risk_limit: float = 0.5, least_confidence: float = 0.4, least_trust: float = 0.3) -> Column:
    """The first reason against: poison, confidence, source; else accepted."""
    return F.when(risk(text) >= risk_limit, "poison").when(adjusted_for_source(base, trust) < least_confidence, "confidence").when(trust < least_trust, "source").otherwise("accepted")
