"""Token ids in Arrow stream files of equal-length sequences.

Each shard is one Arrow stream in a file: record batches of two columns, input_ids (fixed-size list of
unsigned integers) and mask (fixed-size list of booleans). All rows have the same width, so sequence i is at
a known place; a memory-mapped shard hands out views of the file without a copy. Beside it stands an index
stream (doc_id, start, n_tokens; start counts from the shard's first id). Shards follow each other in
ascending doc_id order. A task writes under a name of its own and renames at the end, so a retried or
doubled task leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri.replace("file:", "", 1) if uri.startswith("file:/") else uri)


class ShardWriter:
    """Streams documents' ids into a shard; holds one record batch at a time."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int, rows: int, pad: int = 0):
        import pyarrow as pa

        self.pa, self.dtype, self.length, self.rows, self.pad = pa, dtype, length, rows, pad
        self.fs, root = _at(folder)
        self.final, self.part = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(f"{self.part}.arrow")
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.held, self.n_held, self.total = [], 0, 0
        self.index_out = self.fs.open_output_stream(f"{self.part}.index")
        self.index = pa.ipc.new_stream(self.index_out, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.docs, self.starts, self.sizes = [], [], []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.total)
        self.sizes.append(len(ids))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(False)
        if len(self.docs) >= 10_000:
            self._flush_index()

    def _flush_index(self) -> None:
        pa = self.pa
        self.index.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in (self.docs, self.starts, self.sizes)], names=["doc_id", "start", "n_tokens"]))
        self.docs, self.starts, self.sizes = [], [], []

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = self.length * self.rows
        n = -(-len(ids) // self.length) * self.length if last else len(ids) // step * step
        mask = np.ones(n, bool)
        mask[len(ids) :] = False
        full = np.concatenate([ids, np.full(max(0, n - len(ids)), self.pad, self.dtype)])
        pa = self.pa
        for i in range(0, n, step):
            j = min(i + step, n)
            self.stream.write_batch(
                pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(full[i:j]), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask[i:j]), self.length)], schema=self.schema
                )
            )
        self.held = [] if last else [full[n:]]
        self.n_held = 0 if last else len(full) - n

    def close(self) -> None:
        self._flush(True)
        self.stream.close()
        self.out.close()
        self._flush_index()
        self.index.close()
        self.index_out.close()
        self.fs.move(f"{self.part}.index", f"{self.final}.index")
        self.fs.move(f"{self.part}.arrow", f"{self.final}.arrow")


class Shard:
    """Random access to a shard: sequences, masks and documents' ids as views of the mapped file."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs

        system, path = _at(uri)
        self.source = pa.memory_map(f"{path}.arrow") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(f"{path}.arrow")
        self.batches = list(pa.ipc.open_stream(self.source))
        with system.open_input_file(f"{path}.index") as f:
            self.index = pa.ipc.open_stream(f).read_all()
        self.length = self.batches[0].schema.field("input_ids").type.list_size if self.batches else 1
        self.rows = self.batches[0].num_rows if self.batches else 1
        self.flat = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in self.batches]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> np.ndarray:
        b, r = divmod(i, self.rows)
        return self.flat[b][r * self.length : (r + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        b, r = divmod(i, self.rows)
        return self.batches[b].column(1)[r].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        step, out = self.length * self.rows, []
        while n:
            b, r = divmod(start, step)
            piece = self.flat[b][r : r + n]
            out.append(piece)
            start, n = start + len(piece), n - len(piece)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, length: int = 2048, rows: int = 64, shard_docs: int = 4096) -> list[tuple[str, int, int]]:
    """Write all documents' ids as shards in folder; (shard, first id, ids) of each, in order.

    Null text is empty: its document is the end id alone. Rows that repeat an id follow each other in the
    order of their texts; rows without an id come first. A shard holds about shard_docs documents, one per task,
    which streams them. An empty table gives no shard. Only a row per shard reaches the driver.
    """
    import pyarrow as pa

    system, root = _at(folder)
    system.create_dir(root, recursive=True)

    def run(batches):
        from . import tokens

        part, writer = TaskContext.get().partitionId(), None
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for i, texts in tokens.text_groups(batch.column(1)):
                if writer is None:
                    system_, root_ = _at(folder)
                    system_.create_dir(root_, recursive=True)
                    writer = ShardWriter(folder, f"shard-{part:06d}", enc.dtype, length, rows)
                for d, ids in zip(batch.column(0).slice(i, len(texts)).to_pylist(), enc.encode(texts), strict=True):
                    writer.add(d, np.frombuffer(ids + end, enc.dtype))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([writer.total], pa.int64())], names=["part", "n"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = src.repartitionByRange(max(1, -(-src.count() // shard_docs)), "doc_id").sortWithinPartitions("doc_id", "text")
    written, first = [], 0
    for part, n in sorted(map(tuple, dealt.mapInArrow(run, "part long, n long").collect())):
        written.append((f"{folder}/shard-{part:06d}", first, n))
        first += n
    return written


def read_store(spark, shards: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document, from the files: doc_id, start (over all shards), n_tokens, ids_crc32."""
    import pyarrow as pa

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for path, first, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(path)
                for part in shard.index.to_batches(max_chunksize=10_000):
                    starts, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crc = [zlib.crc32(shard.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + first), part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not shards:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(shards, "path string, first long, n long")
    return files.repartition(len(shards)).mapInArrow(run, schema)
