"""Near-equal names by a greedy edit test, blocked so that no pair outside a block is formed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_close(a: str, b: str, most: int = 3) -> bool:
    """Whether walking both words side by side needs at most `most` skips or changes. Not an edit distance."""
    if abs(len(a) - len(b)) > most:
        return False
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        cost += 1
        if cost > most:
            return False
        if len(a) - i > len(b) - j:
            i += 1
        elif len(a) - i < len(b) - j:
            j += 1
        else:
            i, j = i + 1, j + 1
    return cost + len(a) - i + len(b) - j <= most


@F.pandas_udf(T.BooleanType())
def _close(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([greedy_close(x, y, m) for x, y, m in zip(a, b, most, strict=True)])


def close_names(names: DataFrame, most: int = 3, min_length: int = 8) -> DataFrame:
    """Pairs a < b of distinct names. Of most + 1 pieces of a name at least one stands unchanged in a close one,
    shifted by at most `most`; so pairs meet on a piece and its place, and names are never all held against all."""
    parts = most + 1
    own = names.select("name").distinct().where(F.length("name") >= min_length)
    piece = F.expr(f"transform(sequence(0, {parts - 1}), k -> struct(k * length(name) div {parts} as at, substr(name, k * length(name) div {parts} + 1, (k + 1) * length(name) div {parts} - k * length(name) div {parts}) as part))")
    left = own.select(F.col("name").alias("a"), F.explode(piece).alias("p")).select("a", "p.at", "p.part")
    sizes = F.expr("array_distinct(transform(sequence(greatest(1, length(name) - %d), length(name) + %d), n -> struct(n)))" % (most, most))
    cuts = own.select(F.col("name").alias("b"), F.explode(sizes).alias("s")).select("b", F.col("s.n").alias("n"))
    cuts = cuts.select("b", F.explode(F.expr(f"flatten(transform(sequence(0, {parts - 1}), k -> transform(sequence(greatest(0, k * n div {parts} - {most}), k * n div {parts} + {most}), at -> struct(at, k * n div {parts} as home, substr(b, at + 1, (k + 1) * n div {parts} - k * n div {parts}) as part))))")).alias("p")).select("b", F.col("p.home").alias("at"), "p.part").distinct()
    pairs = left.join(cuts, ["at", "part"]).where("part <> ''").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return pairs.where(F.abs(F.length("a") - F.length("b")) <= most).where(_close("a", "b", F.lit(most)))
