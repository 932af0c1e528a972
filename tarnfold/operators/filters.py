"""Filter conditions and a fluent builder. Every condition is False on a null or missing field, but exists / is_null."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(df: DataFrame, path: str) -> Column:
    """A dotted path; null where the schema has no such field. A numeric part indexes an array."""
    kind, out = df.schema, None
    for part in path.split("."):
        if hasattr(kind, "fieldNames") and part in kind.fieldNames():
            out = F.col(f"`{part}`") if out is None else out.getField(part)
            kind = kind[part].dataType
        elif hasattr(kind, "elementType") and part.isdigit():
            out, kind = F.get(out, F.lit(int(part))), kind.elementType
        elif hasattr(kind, "keyType"):
            out, kind = F.try_element_at(out, F.lit(part)), kind.valueType
        else:
            return F.lit(None)
    return out


def condition(field: Column, op: str, value: Any = None, case_sensitive: bool = True, is_array: bool = False) -> Column:
    """One of: eq ne contains not_contains starts_with ends_with regex in not_in gt gte lt lte between exists is_null."""
    if op == "exists":
        return field.isNotNull()
    if op == "is_null":
        return field.isNull()
    fold = (lambda c: c) if case_sensitive else F.lower
    plain = value if case_sensitive or not isinstance(value, str) else value.lower()
    text = fold(field) if isinstance(value, str) and not is_array else field
    if op == "eq":
        out = text == plain
    elif op == "ne":
        out = text != plain
    elif op in ("contains", "not_contains"):
        out = F.array_contains(field, value) if is_array else F.contains(text, F.lit(plain))
        out = ~out if op[0] == "n" else out
    elif op == "starts_with":
        out = text.startswith(plain)
    elif op == "ends_with":
        out = text.endswith(plain)
    elif op == "regex":
        out = field.rlike(value if case_sensitive else f"(?i){value}")
    elif op in ("in", "not_in"):
        out = F.arrays_overlap(field, F.array(*[F.lit(v) for v in value])) if is_array else field.isin(list(value))
        out = ~out if op[0] == "n" else out
    elif op == "between":
        out = field.between(*value)
    elif op in ("gt", "gte", "lt", "lte"):
        out = {"gt": field > value, "gte": field >= value, "lt": field < value, "lte": field <= value}[op]
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(out, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


class FilterBuilder:
    """``FilterBuilder(df).equals("lang", "en").any_group().contains(...).end().build()`` -> a Column."""

    def __init__(self, df: DataFrame):
        self.df, self.root, self.group, self.how = df, [], None, None

    def where(self, field: str, op: str, value: Any = None, **how) -> FilterBuilder:
        column = nested(self.df, field)
        (self.root if self.group is None else self.group).append(condition(column, op, value, **how))
        return self

    def __getattr__(self, name: str):
        op = {"equals": "eq", "not_equals": "ne", "greater_than": "gt", "less_than": "lt", "at_least": "gte", "at_most": "lte", "one_of": "in", "none_of": "not_in"}.get(name, name)
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda field, value=None, **how: self.where(field, op, value, **how)

    def any_group(self) -> FilterBuilder:
        self.group, self.how = [], any_of
        return self

    def not_group(self) -> FilterBuilder:
        self.group, self.how = [], lambda cs: ~cs[0] if cs else F.lit(True)
        return self

    def end(self) -> FilterBuilder:
        self.root.append(self.how(self.group))
        self.group = None
        return self

    def build(self) -> Column:
        return all_of(self.root)


def common_filter(tags: list[str] | None = None, source: str | None = None, min_confidence: float | None = None, created_after=None, created_before=None) -> Column:
    """Any of the tags, and the source, and the least confidence, and the span of creation."""
    parts = []
    if tags:
        parts.append(condition(F.col("tags"), "in", tags, is_array=True))
    if source:
        parts.append(condition(F.col("source"), "eq", source))
    if min_confidence is not None:
        parts.append(condition(F.col("confidence"), "gte", min_confidence))
    if created_after is not None:
        parts.append(condition(F.col("created_at"), "gte", created_after))
    if created_before is not None:
        parts.append(condition(F.col("created_at"), "lte", created_before))
    return all_of(parts)
