"""Product names: an ordered canonicaliser, list cleanup with reasons, synonyms with a plural fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def cleaned(values: Column, fakes: list[str]) -> Column:
    """Each value with the reason for which it goes, or null."""
    reason = lambda v: F.when(F.length(F.trim(v)) <= 1, "short").when(v.rlike(r"^[\d.,%\s]+$"), "number").when(F.lower(v).isin(fakes or [""]), "fake").when(v.rlike(r"(?i)\bunits?\b"), "unit")
    return F.transform(values, lambda v: F.struct(v.alias("value"), reason(v).alias("reason")))


def resolve(names: DataFrame, synonyms: DataFrame, column: str = "name") -> DataFrame:
    """names with canonical: by synonym (the first listed wins), else by the name without its last s, else itself."""
    table = synonyms.groupBy("synonym").agg(F.min_by("canonical", "ord").alias("found"))
    plural = F.when(F.col(column).rlike("s$") & (F.col(column) != "biomass"), F.expr(f"substr({column}, 1, length({column}) - 1)"))
    out = names.withColumn("__one", plural)
    out = out.join(table.select(F.col("synonym").alias(column), F.col("found").alias("__a")), column, "left").join(table.select(F.col("synonym").alias("__one"), F.col("found").alias("__b")), "__one", "left")
    return out.withColumn("canonical", F.coalesce("__a", "__b", column)).withColumn("resolved", F.coalesce("__a", "__b").isNotNull()).drop("__one", "__a", "__b")
