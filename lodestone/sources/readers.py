"""File sources as DataFrames; all by Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def published(spark: SparkSession, path: str, required: list[str], year: str = "Year") -> DataFrame:
    """A semicolon file with a byte order mark; a missing column, or a year that is no number, raises."""
    df = spark.read.option("header", True).option("sep", ";").option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    number = F.expr(f"try_cast(trim(`{year}`) as int)")
    return df.withColumn(year, F.when(number.isNull(), F.raise_error(F.concat(F.lit("bad year: "), F.coalesce(year, F.lit("null"))))).otherwise(number))


def json_index(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A document {key: record} as rows of key and the record's fields."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{fields}>>")).alias("key", "record"))
    return rows.select("key", "record.*")


def json_maps(spark: SparkSession, glob: str) -> DataFrame:
    """Documents {key: text} of many files as rows."""
    return spark.read.text(glob, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "text"))


def blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """One row per block of a line-oriented file."""
    return spark.read.option("lineSep", separator).text(path).where(F.trim("value") != "").select(F.col("value").alias("block"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """key = value files as (record, path array, value), one row per line with a value."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("record"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    kept = lines.where(F.contains("text", F.lit("=")))
    return kept.select("record", "line", F.split(F.trim(F.substring_index("text", "=", 1)), r"\.").alias("path"), F.trim(F.expr("substr(text, instr(text, '=') + 1)")).alias("value"))


def htext(spark: SparkSession, path: str) -> DataFrame:
    """Lines of level D: (id, name), cut behind the level's seven characters."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("D")))
    parts = F.split(F.expr("substr(value, 8)"), "\t")
    return lines.select(F.trim(parts[0]).alias("gene"), F.trim(F.try_element_at(parts, F.lit(2))).alias("ko"))


def commented_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def model_reactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, reactions array<struct<id: string>>").json(path).select(F.col("id").alias("model"), F.explode("reactions.id").alias("reaction_id"))


def xml_sections(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)


def links(text: DataFrame, column: str, pattern: str) -> DataFrame:
    """Distinct matches of a pattern (its first group) in a text column."""
    return text.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), 1)).alias("link")).distinct()


def by_name(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def route(url, cases: list[tuple[str, str]], default: str = "pdf"):
    """The first extractor whose host occurs in the link."""
    out = F.when(F.lit(False), F.lit(""))
    for host, name in cases:
        out = out.when(F.contains(url, F.lit(host)), F.lit(name))
    return out.otherwise(F.lit(default))


def search_request(terms: list[str], field: str, years: tuple[int, int]) -> list[str]:
    """One search expression a quarter: any of the terms, in that field, between two dates."""
    either = "(" + " OR ".join(f"({t}[{field}])" for t in terms) + ")"
    ends = (("01/01", "03/31"), ("04/01", "06/30"), ("07/01", "09/30"), ("10/01", "12/31"))
    return [f"{either} AND {y}/{a}:{y}/{b}[dp]" for y in range(years[0], years[1] + 1) for a, b in ends]
