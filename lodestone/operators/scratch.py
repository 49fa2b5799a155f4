"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new place in spark.checkpoint.dir; where that is unset, a temporary folder on a local master, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-files-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex[:12]}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in that folder: its lineage is cut, and it outlives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Takes tables that written() made out of that folder; nothing may read them any more."""
    for t in tables:
        spark, plain = t.sparkSession, lambda path: "/" + path.split(":", 1)[-1].lstrip("/")
        base = plain(spark.conf.get("spark.checkpoint.dir"))
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if plain(path).startswith(base):
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
