"""Texts without the words of a lexicon, by a join, so that a lexicon may be of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_lexicon(texts: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "article", fold: bool = False, numbers: bool = True) -> DataFrame:
    """(key, text) without the words of lexicon (word), one blank between those that stay.

    Words are told by white space and compared as they are, or in lower case with fold; without numbers, words of digits
    alone aren't in the lexicon. Each distinct word of a text meets the lexicon once. Null texts stay null; key tells
    rows apart.
    """
    known = lexicon.select("word").where("word <> ''" if numbers else "word <> '' and not word rlike '^[0-9]+$'").distinct()
    folded = F.lower if fold else lambda w: w
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    # only words that the lexicon holds are gathered; the words that stay never leave their text
    each = texts.select(F.col(key).alias("__key"), F.explode(F.array_distinct(F.transform(words, folded))).alias("word"))
    out = each.join(known, "word").groupBy("__key").agg(F.collect_set("word").alias("__out"))
    left = F.filter(words, lambda w: ~F.array_contains("__out", folded(w)))
    kept = F.when(F.col("__out").isNull(), F.array_join(words, " ")).otherwise(F.array_join(left, " "))
    return texts.select(key, text).join(out, F.col(key) == F.col("__key"), "left").select(key, kept.alias(text))
