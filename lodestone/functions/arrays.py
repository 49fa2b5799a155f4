"""Functions on list-valued columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_ignoring_case(values: Column) -> Column:
    """Values in order, each spelling that differs in case only once; the first spelling stays."""
    return F.filter(values, lambda x, i: F.array_position(F.transform(values, F.lower), F.lower(x)) == i + 1)


def split_list(text: Column, separator: str = ",") -> Column:
    """Trimmed, non-empty parts, distinct regardless of case; a text without any is its own only part."""
    parts = distinct_ignoring_case(F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(parts) > 0, parts).otherwise(F.filter(F.array(F.trim(text)), lambda x: x != ""))


def directions(values: Column, known: list[str], other: str = "Other") -> Column:
    """Known directions in order, anything else as other; no direction at all is other too."""
    out = F.array_distinct(F.transform(F.coalesce(values, F.array()), lambda x: F.when(x.isin(known), x).otherwise(F.lit(other))))
    return F.when(F.size(out) == 0, F.array(F.lit(other))).otherwise(out)


def null_if_empty(values: Column) -> Column:
    kept = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def union_null_safe(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def split_products(tokens: Column) -> Column:
    """Token list to product names: a comma ends one, and so does an `and` behind a comma."""
    mark = "\u0001"
    text = F.regexp_replace(F.array_join(tokens, " "), r"\s*,\s*(?:and\s+)?", mark)
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of a token list."""
    return F.when(
        F.size(tokens) > 1,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1))),
    ).otherwise(F.array().cast("array<string>"))


def without_contained(values: Column) -> Column:
    """Values that no longer value of the list contains; equal values once."""
    own = F.array_distinct(values)
    return F.filter(own, lambda x: ~F.exists(own, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x)))
