"""Training articles held against the list of works they were fetched for: mismatches out, curated rows in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_doi(doi: Column) -> Column:
    """A DOI in lower case without blanks and plus signs at its ends, up to its first blank."""
    return F.substring_index(F.trim(F.btrim(F.trim(F.lower(doi)), F.lit("+"))), " ", 1)


def curated(articles: DataFrame, expected: DataFrame, corrections: DataFrame) -> DataFrame:
    """(pm_id, doi, title, abstract, origin) of articles (pm_id, doi, title, abstract), each distinct row once.

    An article goes if a row of expected (pm_id, doi, title) of its id has another DOI than the first of that id, in order
    of DOI, has. Rows of corrections (doi, abstract) come in without an id, with the title that expected has for their DOI
    as it is written, but for quotes. Null ids are never reconciled and stay; a null DOI is no mismatch.
    """
    own = articles.select("pm_id", "doi", "title", "abstract").distinct()
    first = own.where("pm_id is not null").groupBy("pm_id").agg(F.min(plain_doi(F.col("doi"))).alias("has"))
    wanted = expected.select("pm_id", F.btrim("doi", F.lit('"')).alias("doi"), F.btrim("title", F.lit('"')).alias("title"))
    wrong = wanted.join(first, "pm_id").where(plain_doi(F.col("doi")) != F.col("has")).select("pm_id").distinct()
    kept = own.join(wrong, "pm_id", "left_anti").withColumn("origin", F.lit("fetched"))
    titles = wanted.select("doi", "title").distinct()
    added = corrections.select("doi", "abstract").where("doi is not null").distinct().join(titles, "doi", "left")
    return kept.unionByName(added.select(F.lit(None).cast(own.schema["pm_id"].dataType).alias("pm_id"), "doi", "title", "abstract", F.lit("curated").alias("origin")))
