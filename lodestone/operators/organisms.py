"""Organism detection over token lists, by a dictionary of names of several tokens.

The dictionary is a set of small tables made from a taxonomy of full names; tokens meet it as runs of four by equi-joins,
which Spark broadcasts where the dictionary is small enough and shuffles where it is not. What depends on the row (an
abbreviated genus counts only where no full one stands) is told from the tokens that have met a genus, by article.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

# Words that stand for any species, and culture collections, whose number is the next token.
GENERAL = ("pcc", "spp", "sp")
COLLECTIONS = ("pcc", "atcc")
CODE = "^[A-Z0-9]+$"


@dataclass(frozen=True)
class Dictionary:
    """genera (cap, full): capitalised genera, and their initials with full false; pairs (pair, full): lower-cased genus and
    species, and initial and species with full false; codes (code): lower-cased words that may stand behind a general one."""

    genera: DataFrame
    pairs: DataFrame
    codes: DataFrame


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, F.lit(2), F.length(word))))


def dictionary(taxonomy: DataFrame) -> Dictionary:
    """From (genus, full_name): genera may be several, split by a slash; names may hold markup and special characters.

    Initials are those of all genera. Second words with `degrading` are no codes; last words are.
    """
    genera = taxonomy.select(F.explode(F.split("genus", "/")).alias("g")).where("g <> ''").select(F.col("g")).distinct()
    full = genera.select(capital(F.col("g")).alias("cap"), F.lit(True).alias("full"))
    short = genera.select(F.upper(F.left("g", F.lit(1))).alias("cap"), F.lit(False).alias("full"))
    words = taxonomy.where("full_name is not null").select(F.split("full_name", " ").alias("w"), "full_name")
    plain = F.regexp_replace(F.regexp_replace(F.array_join(F.slice("w", 1, 2), " "), "<.*?>", ""), "[^a-zA-Z0-9 ]+", " ")
    name = words.select(F.lower(F.rtrim(plain)).alias("pair")).where("pair rlike '^[^0-9].* '")
    # two words after cleaning, as more can come of a hyphen
    first_two = F.array_join(F.slice(F.filter(F.split("pair", " "), lambda x: x != ""), 1, 2), " ")
    name = name.select(first_two.alias("pair")).distinct()
    brief = name.select(F.concat(F.left("pair", F.lit(1)), F.lit(" "), F.element_at(F.split("pair", " "), 2)).alias("pair"))
    second = words.select(F.lower(F.get("w", F.lit(1))).alias("code")).where("code is not null and code not like '%degrading%'")
    codes = second.union(words.select(F.lower(F.element_at("w", -1)))).where("code <> ''")
    one = lambda a, b, key: a.unionByName(b).groupBy(key).agg(F.max("full").alias("full"), F.max(~F.col("full")).alias("brief"))
    tables = one(full, short, "cap"), one(name.select("pair", F.lit(True).alias("full")), brief.select("pair", F.lit(False).alias("full")), "pair"), codes.distinct()
    # written, so that Spark knows their size: a large taxonomy of few names would be taken for a large dictionary
    return Dictionary(*[scratch.written(t) for t in tables])


def detect(articles: DataFrame, names: Dictionary, tokens: str = "tokens", key: str = "article") -> DataFrame:
    """articles with organisms, an array of distinct names in order of place; null where there are none.

    key tells rows apart. A pair of tokens counts if its first is a genus (an initial where the row has no full genus),
    doesn't start with a digit, and not both are single characters. It names an organism if it is a name of the
    dictionary or its second token is a general word; behind a general word a third token is taken along if it is
    a code, and a fourth if the third is a culture collection and the fourth a code. Rows without any take pairs of an
    initial and a species; rows without these `yeast`, where that word stands. Null tokens, and null or empty arrays,
    match nothing.
    """
    w = lambda i: F.coalesce(F.get(tokens, i), F.lit(""))
    runs = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.struct(w(i).alias("a"), w(i + 1).alias("b"), w(i + 2).alias("c"), w(i + 3).alias("d")))
    four = articles.where(F.size(tokens) > 1).select(F.col(key).alias("__key"), F.posexplode(runs).alias("pos", "r")).select("__key", "pos", "r.*").where("a <> '' and b <> ''")
    met = four.withColumn("cap", capital(F.col("a"))).join(names.genera.withColumnsRenamed({"full": "genus", "brief": "initial"}), "cap")
    met = met.withColumn("fits", ~F.col("a").rlike("^[0-9]") & ~((F.length("a") == 1) & (F.length("b") == 1)))
    met = met.withColumn("pair", F.lower(F.concat_ws(" ", "a", "b"))).withColumn("general", F.lower("b").isin(*GENERAL))
    named = met.join(names.pairs, "pair", "left").withColumn("named", F.col("fits") & (F.coalesce("full", F.lit(False)) | F.coalesce("brief", F.lit(False)) | F.col("general")))
    named = named.where("genus or named")
    third, fourth = names.codes.select(F.col("code").alias("c3"), F.lit(True).alias("k3")), names.codes.select(F.col("code").alias("c4"), F.lit(True).alias("k4"))
    named = named.join(third, F.col("general") & (F.lower("c") == F.col("c3")), "left").join(fourth, F.col("general") & F.lower("c").isin(*COLLECTIONS) & (F.lower("d") == F.col("c4")), "left")
    collection = F.lower("c").isin(*COLLECTIONS)
    takes3 = F.col("general") & (F.col("c") != "") & (F.col("c").rlike(CODE) | F.col("k3").isNotNull() | collection)
    takes4 = takes3 & collection & (F.col("d") != "") & (F.col("d").rlike(CODE) | F.col("k4").isNotNull())
    name = F.when(takes4, F.concat_ws(" ", "a", "b", "c", "d")).when(takes3, F.concat_ws(" ", "a", "b", "c")).otherwise(F.concat_ws(" ", "a", "b"))
    sure = F.coalesce(F.col("full"), F.lit(False)) | F.col("general")
    # initials count by what the row holds, which is told once its names are together; rows travel as names, not as tokens
    hits = named.select("__key", "genus", F.when(F.col("named"), F.struct("pos", name.alias("name"), "genus", sure.alias("sure"))).alias("hit"))
    found = hits.groupBy("__key").agg(F.max("genus").alias("any"), F.sort_array(F.collect_list("hit")).alias("hits"))
    in_order = lambda which: F.array_distinct(F.transform(F.filter("hits", lambda h: (h["genus"] | ~F.col("any")) & which(h["sure"])), lambda h: h["name"]))
    found = found.select("__key", in_order(lambda s: s).alias("__sure"), in_order(lambda s: ~s).alias("__brief"))
    # told before the join, which then carries no tokens for those who ask for names alone
    out = articles.withColumn("__yeast", F.exists(tokens, lambda t: F.lower(t) == "yeast")).join(found, F.col(key) == F.col("__key"), "left")
    yeast = F.when(F.col("__yeast"), F.array(F.lit("yeast")))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return out.withColumn("organisms", F.coalesce(some("__sure"), some("__brief"), yeast)).drop("__key", "__sure", "__brief", "__yeast")


def cascade(articles: DataFrame, sources: list[str], extract, out: str, ignore: Column | None = None) -> DataFrame:
    """extract(frame, column) on the first source that yields a value, with where it came from.

    A value equal to ignore is none. Only rows that are still without a value reach the next source, so a costly
    extractor sees each once; the rows left are written to the shared folder between sources, so that no source before
    is asked again.
    """
    left, done = articles, None
    for column in sources:
        tried = extract(left, column)
        value = F.when(F.col(out) != ignore, F.col(out)) if ignore is not None else F.col(out)
        tried = scratch.written(tried.withColumn(out, value).withColumn(f"{out}_source", F.when(F.col(out).isNotNull(), F.lit(column))))
        hit = tried.where(F.col(out).isNotNull())
        done = hit if done is None else done.unionByName(hit)
        left = tried.where(F.col(out).isNull()).drop(out, f"{out}_source")
    rest = left.withColumn(out, F.lit(None).cast(dict(done.dtypes)[out])).withColumn(f"{out}_source", F.lit("not_found"))
    return done.unionByName(rest)
