"""Sinks: never overwrite, and safe cells."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell


def exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save(df: DataFrame, path: str) -> str:
    """Write by the path's suffix; where it is taken, under its stem with _new_v1, _new_v2, ... The path written to."""
    m = re.fullmatch(r"(.*)\.(parquet|csv|tsv|json|orc)", path)
    if not m:
        raise ValueError(f"no writer for {path}")
    stem, kind, out, n = m[1], m[2], path, 0
    while exists(df.sparkSession, out):
        n += 1
        out = f"{stem}_new_v{n}.{kind}"
    writer = df.write.mode("errorifexists")
    if kind in ("csv", "tsv"):
        writer = writer.option("header", True).option("escape", '"').option("sep", "," if kind == "csv" else "\t")
    writer.format("csv" if kind == "tsv" else kind).save(out)
    return out


def append_tsv(df: DataFrame, path: str) -> None:
    flat = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ").alias(c) for c in df.columns]
    df.select(*flat).write.mode("append").option("sep", "\t").csv(path)


def by_year(df: DataFrame, path: str, column: str = "year") -> None:
    df.write.partitionBy(column).option("header", True).csv(path)


def export_lines(df: DataFrame) -> DataFrame:
    """One CSV line per row, all cells quoted and guarded against formulas; write with CRLF."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in df.columns]).alias("value"))


def export_csv(df: DataFrame, path: str) -> None:
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    lines = df.sparkSession.createDataFrame([("\ufeff" + head,)], "value string").unionByName(export_lines(df))
    lines.coalesce(1).write.option("lineSep", "\r\n").text(path)


def document(records: DataFrame, meta: DataFrame, path: str) -> None:
    """Records as JSON lines beside one meta document; the records never meet in one place."""
    records.write.json(f"{path}/records")
    meta.coalesce(1).write.json(f"{path}/meta")
