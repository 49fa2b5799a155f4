"""Mixture-controlled packing: deficit round-robin over source queues into windows of equal length.

Every source is a queue in the order of a hash, and each named source is consumed at its target's rate until it is
dry; then the others share what it leaves. That schedule gives each document its place among all ids, and documents
are dealt by it into chunks of about chunk_tokens ids: a chunk holds what its windows need, and its size is bounded
whatever the sources' sizes. No chunk reaches over the point where a source runs dry. In a chunk each window gives
source s its quantum, which is what the chunk holds of s spread evenly over its windows (the target, but for the
sizes of documents), plus the deficit that it carries; it serves the queues in order of what they are owed and fills
what is left from the others. A chunk starts with the deficits that all chunks before it leave, up to CARRIED of a
window a source, so that no window makes up for all of them; they follow from per-chunk sums and the schedule. Only
the last window of a chunk can be short, so padding is below window / chunk_tokens of all ids.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

CARRIED = 0.05
NO_ID = -(1 << 63)  # stands for a null id inside a chunk
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 1, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """doc_id, the columns of keep, n_tokens and ids (little-endian; 2 bytes each if the vocabulary allows)."""
    import pyarrow as pa

    def run(batches):
        from . import tokens

        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            last = batch.num_columns - 1
            for i, texts in tokens.text_groups(batch.column(last)):
                ids = [x + end for x in enc.encode(texts)]
                part = batch.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in range(last)] + [pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), pa.array([enc.dtype.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                    names=part.schema.names[:-1] + ["n_tokens", "width", "ids"],
                )

    src = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in keep], F.col("text").cast("string"))
    return src.mapInArrow(run, ", ".join(["doc_id long", *[f"{c} string" for c in keep], "n_tokens long", "width int", "ids binary"]))


def fill_windows(share: np.ndarray, owed: np.ndarray, have: np.ndarray, window: int) -> np.ndarray:
    """take[w, s]: how many ids window w takes from queue s, by deficit round-robin. All of have is taken."""
    left, owed = have.astype(np.int64).copy(), owed.astype(float).copy()
    total, takes = int(left.sum()), []
    while total > 0:
        size = min(window, total)
        owed += share * size
        take = np.minimum(np.maximum(np.floor(owed), 0).astype(np.int64), left)
        over = int(take.sum()) - size
        if over:
            # the queues that are owed most come first, both to give up least and to fill what is left
            for s in np.argsort(-owed, kind="stable") if over < 0 else np.argsort(owed, kind="stable"):
                step = min(-over, int(left[s] - take[s])) if over < 0 else -min(over, int(take[s]))
                take[s] += step
                over += step
                if not over:
                    break
        left -= take
        owed -= take
        total -= size
        takes.append(take)
    return np.array(takes, np.int64).reshape(len(takes), len(share))


class Schedule:
    """Which source gives how much by when. Time is such that a named source gives its share in each unit of it."""

    def __init__(self, targets: dict[str, float], totals: dict[str | None, int], rest: int):
        weight = {k: float(w) for k, w in targets.items() if w > 0 and totals.get(k)}
        self.share = {k: w / sum(weight.values()) for k, w in weight.items()}
        self.dry = {k: totals[k] / q for k, q in self.share.items()}  # when each has given all
        self.last, self.rest = max(self.dry.values(), default=0.0), rest  # then the sources without a target, all at once
        self.times = [0.0, *sorted(self.dry.values()), self.last + 1]
        self.given = [sum(q * min(t, self.dry[k]) for k, q in self.share.items()) + rest * max(0.0, t - self.last) for t in self.times]

    def owed(self, source: str | None, total: int, ids: float) -> float:
        """What a source should have given once all have given so many ids."""
        t = float(np.interp(ids, self.given, self.times))
        return self.share[source] * min(t, self.dry[source]) if source in self.share else total * max(0.0, t - self.last)

    def chunks(self, place: "F.Column", most: int) -> tuple["F.Column", list[float]]:
        """The chunk of a place, and where each chunk begins: stretches between dry points in even parts of up to most ids."""
        starts, parts = [], []
        for a, b in zip(self.given[:-1], self.given[1:], strict=True):
            if b > a or not starts:
                n = max(1, math.ceil((b - a) / most))
                parts.append(F.struct(F.lit(a).alias("a"), F.lit(max(b - a, 1.0) / n).alias("step"), F.lit(len(starts)).alias("base"), F.lit(n - 1).alias("last")))
                starts += [a + (b - a) * i / n for i in range(n)]
        where = F.aggregate(F.array(*parts), F.lit(0).cast("long"), lambda s, x: F.when(place >= x["a"], x["base"] + F.least(F.floor((place - x["a"]) / x["step"]), x["last"].cast("long"))).otherwise(s))
        return where, starts

    def place(self, source: "F.Column", u: "F.Column") -> "F.Column":
        """The place among all ids of what stands at fraction u of its source."""
        dry = F.create_map(*[F.lit(x) for k, v in self.dry.items() for x in (k, v)]) if self.dry else F.lit(None).cast("map<string,double>")
        t = F.coalesce(F.try_element_at(dry, F.coalesce(source, F.lit(""))) * u, u + self.last)
        named = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(self.dry[k]).alias("d")) for k, q in self.share.items()]) if self.share else F.array().cast("array<struct<q: double, d: double>>")
        return F.aggregate(named, F.greatest(t - self.last, F.lit(0.0)) * float(self.rest), lambda s, x: s + x["q"] * F.least(t, x["d"]))


def _pack_chunk(window: int, with_ids: bool, schedule: Schedule | None, starts: list[float], total: int):
    import pyarrow as pa

    def run(rows: pa.Table, stats: pa.Table) -> pa.Table:
        names = sorted({x for x in rows.column("source").to_pylist()}, key=lambda x: (x is not None, x or ""))
        at, owed = {x: i for i, x in enumerate(names)}, np.zeros(len(names))
        start = starts[int(rows.column("chunk")[0].as_py())] if schedule else int(rows.column("chunk")[0].as_py()) * starts[0]
        for s, before, all_n in zip(*(stats.column(c).to_pylist() for c in ("source", "before", "all_n")), strict=True):
            owed[at[s]] = (all_n * start / total if schedule is None else schedule.owed(s, all_n, start)) - before
        queue = np.array([at[x] for x in rows.column("source").to_pylist()])
        ids_of, doc, n = rows.column("ids").combine_chunks(), rows.column("doc_id").fill_null(NO_ID).to_numpy(), rows.column("n_tokens").to_numpy()
        width = rows.column("width")[0].as_py()
        order = np.lexsort((doc, queue))
        have = np.bincount(queue, weights=n, minlength=len(names)).astype(np.int64)
        share = have / have.sum()
        owed = np.clip(owed, -CARRIED * window, np.minimum(have, CARRIED * window))  # only what can still be served is carried
        take = fill_windows(share, owed, have, window)
        base = np.cumsum(take, 1) - take  # where a source's ids stand in each window
        chunk = int(rows.column("chunk")[0].as_py())
        out = {k: [] for k in ("doc_id", "source", "start", "length", "crc", "doc_tokens", "sequence", "offset", "ids")}
        for s, name in enumerate(names):
            own = order[queue[order] == s]
            data = np.frombuffer(b"".join(ids_of[int(r)].as_py() for r in own), f"<u{width}").astype("<u4")
            doc_end = np.cumsum(n[own])
            doc_from = doc_end - n[own]
            win_end = np.cumsum(take[:, s])
            cut = np.unique(np.concatenate([[0], doc_end, win_end]))
            lo, hi = cut[:-1], cut[1:]
            d = np.searchsorted(doc_end, lo, "right")
            w = np.searchsorted(win_end, lo, "right")
            raw = data.view(np.uint8)
            out["doc_id"].append(doc[own][d])
            out["source"] += [name] * len(lo)
            out["start"].append(lo - doc_from[d])
            out["length"].append(hi - lo)
            out["crc"].append(np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.int64))
            out["doc_tokens"].append(n[own][d])
            out["sequence"].append(w + (chunk << 32))
            out["offset"].append(base[w, s] + lo - (win_end[w] - take[w, s]))
            out["ids"] += [raw[4 * a : 4 * b].tobytes() if with_ids else None for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        whole = lambda k: pa.array(np.concatenate(out[k]).astype(np.int64))
        return pa.table(
            [pa.array(docs_out := np.concatenate(out["doc_id"]).astype(np.int64), mask=docs_out == NO_ID), pa.array(out["source"], pa.string()), whole("start"), whole("length"), whole("crc"), whole("doc_tokens"), whole("sequence"), whole("offset"), pa.array(out["ids"], pa.binary())],
            names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    return run


def pack(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, chunk_tokens: int = 4_000_000, targets: dict[str, float] | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece of a document: which ids of it stand at which offset of which window.

    targets gives sources' shares, in any scale: every window holds them while the sources last. Sources that it doesn't
    name follow once those are dry. Without it the corpus's own shares hold. Null text is empty, so the document is its
    end id alone; a null source is a queue of its own; a null id stays null; rows that repeat an id are packed one by one
    (those of the same id and text in one chunk); an empty table gives no piece.
    """
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit(None).cast("string"))
    tok = C.materialise(tokenise(docs, tokenizer, end_id), "tokens")
    total = tok.agg(F.sum("n_tokens")).first()[0] or 0
    chunks = max(1, -(-total // chunk_tokens))
    # a second hash than the shuffle's, so that chunks of one id range don't meet in one task
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "ids", F.lit("chunk")), 11) / float(1 << 53)
    schedule, starts = None, [max(total, 1) / chunks]
    chunk = F.least(F.floor(u * float(chunks)), F.lit(chunks - 1))
    if targets is not None:
        named = tok.where(F.col("source").isin(*targets)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect() if targets else []
        totals = {r[0]: r[1] for r in named}  # as many as there are targets
        schedule = Schedule(targets, totals, total - sum(v for k, v in totals.items() if targets[k] > 0))
        chunk, starts = schedule.chunks(schedule.place(F.col("source"), u), chunk_tokens)
    dealt = tok.withColumn("chunk", chunk.cast("long"))
    sums = C.materialise(dealt.groupBy("chunk", "source").agg(F.sum("n_tokens").alias("n")), "chunk-sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("all_n"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    stats = (
        sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .alias("x")
        .join(by_source.alias("q"), F.expr("x.source <=> q.source"))
        .select("chunk", "x.source", "before", "all_n")
    )
    return dealt.groupBy("chunk").cogroup(stats.groupBy("chunk")).applyInArrow(_pack_chunk(window, with_ids, schedule, starts, max(total, 1)), PIECES)
