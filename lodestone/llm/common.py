"""What the corpus operators share: scratch tables, byte helpers and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bound what a Python worker is sent at once by bytes; a value set by the user stays."""
    if spark.conf.get(_BATCH, None) in (None, "67108864", "64MB", "64m", "-1"):
        spark.conf.set(_BATCH, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. On a local master, where it may be unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex[:12]}-{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut and lost executors cost nothing.

    The shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # a new frame, as the plan of df may have been made before the setting
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files behind tables that materialise() made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        base = scratch_dir(spark)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.replace("file:///", "file:/").startswith(base.replace("file:///", "file:/")):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(id, component) for each end of an edge; component is the smallest id reachable.

    Alternating large-star and small-star steps, each a grouped minimum and an equi-join, so a hub is
    pre-aggregated and can be split by the skew join. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    now = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}-0"
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = materialise(small, name)
        drop_scratch(now)
        now = after
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def with_component(nodes: DataFrame, node: str, comps: DataFrame, out: str = "component") -> DataFrame:
    return nodes.join(comps.select(F.col("id").alias(node), F.col("component").alias(out)), node, "left").withColumn(
        out, F.coalesce(out, node)
    )


# ---- bytes of Arrow string columns ---------------------------------------------------------------


def string_spans(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of a string column's rows, without a copy; a null row is an empty span."""
    import pyarrow as pa

    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        none = np.zeros(len(arr), np.int64)
        return np.zeros(0, np.uint8), none, none
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, end = offs[:-1].copy(), offs[1:].copy()
    if arr.null_count:
        gone = ~np.asarray(arr.is_valid())
        end[gone] = start[gone]
    return raw, start, end


def byte_slices(start: np.ndarray, end: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (i, j) that hold about limit bytes each; a longer row stands alone."""
    i, n = 0, len(start)
    total = np.cumsum(end - start)
    while i < n:
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + limit, "right")))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays (wraps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


KEPT_POWERS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: int, key: str) -> np.ndarray:
    """base to the powers 0 to n - 1; a table of up to KEPT_POWERS stays with the worker."""
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << (n - 1).bit_length()) if n <= KEPT_POWERS else n
        have = np.full(size, base, np.uint64)
        have[:1] = 1
        have = np.multiply.accumulate(have)
        if size <= KEPT_POWERS:
            _POWERS[key] = have
    return have[:n]


def release() -> None:
    """Give back what Arrow's allocator holds on to, as idle workers keep it otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] = sum of values[k]*B^k over i <= k < j, modulo 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(len(values), _BASE, "p"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span that depends on its content and length only."""
    inverse = _powers(len(prefix), pow(_BASE, -1, 1 << 64), "i")
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_table(separator, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(byte -> folded byte, byte -> is a word byte)."""
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    word = np.array([not separator(int(fold[b])) for b in range(256)])
    return fold, word


def words_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, first word of each row, one past its last) for consecutive rows of a slice."""
    fold, word = tables
    lo, hi = (int(start[0]), int(end[-1])) if len(start) else (0, 0)
    data = raw[lo:hi]
    s, e = start - lo, end - lo
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[s[s < e]] = inside[s[s < e]]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = e[s < e] - 1
    stops[last] = inside[last]
    ws = np.flatnonzero(begins)
    we = np.flatnonzero(stops) + 1
    prefix = prefix_hash(fold[data])
    return span_hash(prefix, ws, we), np.searchsorted(ws, s), np.searchsorted(ws, np.maximum(s, e))
