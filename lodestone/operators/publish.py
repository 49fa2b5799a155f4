"""Publishing: a checked source file becomes records, meta and ranked labels, which appear together or not at all."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from ..functions.text import parse_genes
from . import scratch

REQUIRED = ("PMID", "Title", "Year", "Organism", "Product", "Genes_and_modifications")
KNOWN = ["Positive", "Negative", "Other"]
_FILE, _BLOCK, _ID = "__file", "__block", "__id"


def source(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED, sep: str = ";") -> DataFrame:
    """The rows of a file with a header, all as trimmed strings (null: empty), with their places; a missing column raises.

    A byte order mark may stand in front. The rows are a table in the shared folder, so that places stay.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    if missing := sorted(set(required) - set(names)):
        raise ValueError(f"Source CSV is missing required columns: {', '.join(missing)}")
    clean = [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(n) for c, n in zip(raw.columns, names, strict=True)]
    return scratch.written(raw.select(*clean, F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_ID)))


@F.pandas_udf(T.StringType())
def gene_fault(s: pd.Series) -> pd.Series:
    """What is wrong with a mapping literal, or null."""
    import ast

    def one(t):
        if not t:
            return None
        try:
            value = ast.literal_eval(t)
        except (SyntaxError, ValueError):
            return "Invalid Genes_and_modifications"
        return None if isinstance(value, dict) else "Genes_and_modifications must be a dictionary"

    return s.map(one)


def checked(rows: DataFrame) -> DataFrame:
    """rows, after a pass that raises for the first faulty one, with its row in the file (the header is row 1).

    Only where there is a fault are rows counted: those of the blocks before it, and those before it in its own block.
    """
    fault = F.coalesce(F.when(F.expr("try_cast(Year as int)").isNull(), F.lit("Invalid year")), gene_fault("Genes_and_modifications"))
    first = rows.withColumn("__fault", fault).where(F.col("__fault").isNotNull()).orderBy(_FILE, _BLOCK, _ID).select(_FILE, _BLOCK, _ID, "__fault").limit(1).collect()
    if first:
        file, block, at, what = first[0]
        before = rows.where((F.col(_FILE) == file) & ((F.col(_BLOCK) < block) | ((F.col(_BLOCK) == block) & (F.col(_ID) < at)))).count()
        raise ValueError(f"{what} at CSV row {before + 2}")
    if rows.isEmpty():
        raise ValueError("Source CSV contains no data records")
    return rows


def split_products(value: Column) -> Column:
    """The whole value and, where it has commas, each of its parts; spellings that differ in case once; none for an empty value."""
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    every = F.when(F.contains(value, F.lit(",")), F.concat(F.array(value), parts)).otherwise(F.array(value))
    return F.when(value == "", F.array().cast("array<string>")).otherwise(arrays.distinct_ignoring_case(every))


def records(rows: DataFrame) -> DataFrame:
    way = lambda g: arrays.directions(F.filter(F.transform(F.split(F.array_join(g["directions"], ","), ","), lambda x: F.trim(x)), lambda x: x != ""), KNOWN)
    genes = F.transform(F.filter("__g", lambda g: g["name"] != ""), lambda g: F.struct(g["name"].alias("name"), way(g).alias("directions")))
    parsed = rows.withColumn("__g", parse_genes("Genes_and_modifications"))
    return parsed.select(
        F.col("PMID").alias("pmid"),
        F.col("Title").alias("title"),
        F.col("Year").cast("int").alias("year"),
        F.col("Organism").alias("organism"),
        arrays.split_list(F.col("Organism")).alias("organisms"),
        F.col("Product").alias("product"),
        split_products(F.col("Product")).alias("products"),
        genes.alias("genes"),
    )


def label_table(found: DataFrame) -> DataFrame:
    """(kind, label, n) of organisms, products (whole values) and genes, each occurrence counted."""
    genes = F.transform("genes", lambda g: g["name"])
    whole = F.when(F.col("product") != "", F.array("product")).otherwise(F.array().cast("array<string>"))
    each = F.concat(_kind("organism", F.col("organisms")), _kind("product", whole), _kind("gene", genes))
    return found.select(F.explode(each).alias("e")).groupBy("e.kind", "e.label").agg(F.count("*").alias("n"))


def _kind(kind: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))


def meta(found: DataFrame, labels: DataFrame, limit: int = 300) -> DataFrame:
    """One row: counts, years and the most frequent labels of each kind, ties in order of the case-folded label."""
    counts = found.agg(F.count("*").alias("recordCount"), F.min("year").alias("minYear"), F.max("year").alias("maxYear"))
    for kind in ("organism", "product", "gene"):
        own = labels.where(F.col("kind") == kind)
        counts = counts.crossJoin(own.agg(F.count("*").alias(f"{kind}Count")))  # one row each
        top = own.orderBy(F.desc("n"), F.lower("label"), "label").limit(limit)
        counts = counts.crossJoin(top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.lower("label").alias("k"), "label"))), lambda s: s["label"]).alias(f"{kind}Suggestions")))
    return counts


# ---- several outputs at once ------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, out: str) -> list[int]:
    """The numbers of the versions that are complete, in order."""
    fs, p = _fs(spark, out)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))
    return [n for n in numbers if fs.exists(_fs(spark, f"{out}/v{n}/_COMMITTED")[1])]


def commit_together(spark: SparkSession, out: str, outputs: dict[str, tuple[DataFrame, str]]) -> int:
    """Write all outputs (name: frame and format) as the next version of out, and mark it; its number.

    Readers take the last marked version, so a failure at any point leaves what they see as it was.
    """
    fs, p = _fs(spark, out)
    taken = [int(m[1]) for s in (fs.listStatus(p) if fs.exists(p) else []) if (m := re.fullmatch(r"v(\d+)", s.getPath().getName()))]
    n = max(taken, default=0) + 1
    for name, (df, kind) in outputs.items():
        df.write.format(kind).save(f"{out}/v{n}/{name}")
    marker = _fs(spark, f"{out}/v{n}/_COMMITTED")
    marker[0].create(marker[1], False).close()
    return n


def current(spark: SparkSession, out: str, name: str, schema, kind: str = "json") -> DataFrame:
    done = versions(spark, out)
    if not done:
        raise ValueError(f"nothing is published in {out}")
    return spark.read.schema(schema).format(kind).load(f"{out}/v{done[-1]}/{name}")


def publish(spark: SparkSession, path: str, out: str, limit: int = 300) -> int:
    """Source file to records, meta and labels in out; the number of the version. Faults raise before anything is written."""
    rows = checked(source(spark, path))
    found = scratch.written(records(rows))
    labels = scratch.written(label_table(found))
    file = F.lit(path.rstrip("/").rsplit("/", 1)[-1])
    return commit_together(spark, out, {"records": (found, "json"), "labels": (labels, "json"), "meta": (meta(found, labels, limit).withColumn("sourceFile", file).coalesce(1), "json")})
