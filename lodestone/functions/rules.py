"""Ordered rewriting rules compiled into one column expression; their order is their meaning."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str
    literal: bool = False


def rewrite(text: Column, rules: list[Rule]) -> Column:
    """Apply all rules, each to the result of those before it. Null stays null."""
    step = lambda c, r: F.replace(c, F.lit(r.pattern), F.lit(r.replacement)) if r.literal else F.regexp_replace(c, r.pattern, r.replacement)
    return reduce(step, rules, text)


def first_match(text: Column, cases: list[tuple[str, object]], default: Column) -> Column:
    """The value of the first case whose pattern occurs in text."""
    out = None
    for pattern, value in cases:
        out = (F if out is None else out).when(text.rlike(pattern), F.lit(value))
    return default if out is None else out.otherwise(default)


def without_words(text: Column, words: list[str], suffixes: str = "") -> Column:
    """Whole words, with any of the letters in suffixes after them, taken out regardless of case."""
    if not words:
        return text
    tail = "".join(f"{c}?" for c in suffixes)
    return F.regexp_replace(text, rf"(?i)\b(?:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))}){tail}\b", "")
