"""Gene dictionaries, the gene finder, and lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_hop_dictionary(pairs: DataFrame) -> DataFrame:
    """(name, entry) pairs: per name all entries and names at most two steps away. Not a closure."""
    entries = pairs.select("name", "entry").distinct()
    near = entries.alias("a").join(entries.alias("b"), F.col("a.entry") == F.col("b.entry")).select(F.col("a.name").alias("name"), F.col("b.name").alias("other")).distinct()
    reach = near.join(entries.select(F.col("name").alias("other"), "entry"), "other")
    return reach.groupBy("name").agg(F.array_sort(F.collect_set("other")).alias("names"), F.array_sort(F.collect_set("entry")).alias("entries"))


def find(tokens: DataFrame, dictionary: DataFrame, fakes: DataFrame | None = None) -> DataFrame:
    """tokens (article, pos, token) x dictionary (gene): genes of the first spelling that finds any.

    Spellings in order: as written, first letter upper, all upper, all lower but a last capital.
    """
    t = F.col("token")
    forms = [t, F.concat(F.upper(F.substring(t, 1, 1)), F.expr("substr(token, 2)")), F.upper(t), F.concat(F.lower(F.expr("substr(token, 1, length(token) - 1)")), F.upper(F.expr("substr(token, -1)")))]
    each = tokens.where(F.length("token") > 0).select("article", "pos", F.posexplode(F.array(*forms)).alias("step", "gene"))
    if fakes is not None:
        each = each.join(fakes.select(F.col("gene")).distinct(), "gene", "left_anti")
    hit = each.join(dictionary.select("gene").distinct(), "gene")
    # one grouping of what was found: each spelling's genes side by side, the first that has any is taken
    sets = hit.groupBy("article").agg(*[F.collect_set(F.when(F.col("step") == i, F.col("gene"))).alias(f"s{i}") for i in range(len(forms))])
    first = lambda value: F.coalesce(*[F.when(F.size(f"s{i}") > 0, value(i)) for i in range(len(forms))])
    return sets.select("article", first(lambda i: F.array_sort(f"s{i}")).alias("genes"), first(lambda i: F.lit(i)).alias("step"))


def lookup(rows: DataFrame, exact: DataFrame, popular: DataFrame) -> DataFrame:
    """rows (organism, gene): ecs of the pair, else of the popular organism with the best rank that has the gene."""
    e = exact.groupBy("organism", "gene").agg(F.array_sort(F.collect_set("ec")).alias("__exact"))
    p = popular.groupBy("gene", "rank").agg(F.array_sort(F.collect_set("ec")).alias("ecs")).groupBy("gene").agg(F.min_by("ecs", "rank").alias("__popular"))
    out = rows.join(e, ["organism", "gene"], "left").join(p, "gene", "left")
    return out.withColumn("ecs", F.coalesce("__exact", "__popular")).withColumn("step", F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__popular").isNotNull(), "popular").otherwise("none")).drop("__exact", "__popular")


def variants(name) -> "F.Column":
    """A name with each digit, capital letter and roman numeral up to X behind it."""
    ends = [str(d) for d in range(10)] + [chr(c) for c in range(65, 91)] + ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
    return F.array_distinct(F.array(name, *[F.concat(name, F.lit(e)) for e in ends]))
