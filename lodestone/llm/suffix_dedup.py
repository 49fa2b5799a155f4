"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts elsewhere.

Equal strings must meet in one array, and no task may hold the corpus. So every start of a `length`-byte
string is dealt by the smallest hashed `gram`-byte gram inside that string, which is a function of its bytes
alone. Starts that share the same gram occurrence form one segment (their strings' union). Grams that occur
once drop out. A string holds its gram and length - gram bytes around it, of which some number of quarters
(PARTS) stands before it; so two equal strings also share one of PARTS probes, which reach over the gram and
all but one part. Segments whose probes all occur once drop out too: nothing in them can repeat. Segments of
equal content become one kind with a multiplicity, in whose own strings every suffix has an equal; the kinds
of a gram go on if there is one among them that occurs once, and so depends on the others. Segments meet in shards by their
gram: each shard is one text whose suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai)
tell which starts have an equal neighbour. A gram with more distinct content than a shard holds is split
over several shards, and each is merged with the others by binary search of its starts in their arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import suffix

SHARD_BYTES = 1_500_000
STRETCH = 300_000
PARTS = 8
_PLAIN = C.byte_table(lambda b: False, lower=False)[0]
_POS = np.uint64((1 << 28) - 1)
NO_ID = (1 << 63) - 1  # stands for a null id in joins


def _lowest(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each width consecutive keys."""
    out, have = key, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def segments(raw: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int):
    """(row, gram hash, two digests, first start, starts, probes) of every segment of a slice's rows."""
    # the rows' bytes side by side, as stretches of one text overlap
    size = end - start
    e = np.cumsum(size)
    s = e - size
    n = int(e[-1])
    data = raw[np.arange(n) + np.repeat(start - s, size)] if (start[1:] != end[:-1]).any() else raw[int(start[0]) : int(end[-1])]
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty, empty, np.zeros((0, PARTS), np.int64)
    prefix = C.prefix_hash(data)
    inverse = C._powers(n + 1, pow(C._BASE, -1, 1 << 64), "i")
    grams = C.mix64((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    # a gram's place breaks ties in favour of the first, which depends on the string's bytes alone too
    place = np.arange(len(grams), dtype=np.uint64)
    picks = (_lowest((grams & ~_POS) | (place & _POS), length - gram + 1) & _POS).astype(np.int64)
    rows, first, stop = [], [], []
    count = np.maximum(e - s - length + 1, 0)
    has = np.flatnonzero(count)
    inside = np.zeros(len(picks) + 1, np.int8)
    np.add.at(inside, s[has], 1)
    np.add.at(inside, s[has] + count[has], -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= (picks[1:] != picks[:-1]) | ~ok[:-1]
    new[s[has]] = True
    first = np.flatnonzero(new)
    ends = ok.copy()
    ends[:-1] &= new[1:] | ~ok[1:]
    stop = np.flatnonzero(ends) + 1
    rows = np.searchsorted(s, first, "right") - 1
    # rows without bytes share their start with the next row
    gone = (e - s)[rows] < length
    if gone.any():
        rows[gone] = has[np.searchsorted(s[has], first[gone], "right") - 1]
    d1 = C.span_hash(prefix, first, stop - 1 + length)
    second = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(77)) * C._powers(n, 0xD1342543DE82EF95, "q"), out=second[1:])
    inverse = C._powers(n + 1, pow(0xD1342543DE82EF95, -1, 1 << 64), "qi")
    d2 = C.mix64((second[stop - 1 + length] - second[first]) * inverse[first])
    at, over = picks[first], stop - 1 + length
    part = -(-(length - gram) // PARTS)
    probes = np.zeros((len(first), PARTS), np.int64)
    for k in range(PARTS):
        a, b = at - part * k, at + gram + length - gram - part * (k + 1)
        if length - gram < part * (k + 1):
            b = at + gram
        ok = (a >= first) & (b <= over)
        probes[ok, k] = C.span_hash(prefix, a[ok], b[ok]).view(np.int64) ^ np.int64(k * 0x5851F42D4C957F2D % (1 << 62))
    return rows, grams[at].view(np.int64), d1.view(np.int64), d2.view(np.int64), first - s[rows], stop - first, probes


def _segment_batches(length: int, gram: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw, start, end = C.string_spans(batch.column(2))
            # a long text goes in stretches that overlap by length - 1 bytes, so that each string starts in one of them
            count = np.maximum(-(-(end - start - length + 1) // STRETCH), 1)
            row = np.repeat(np.arange(len(start)), count)
            skip = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
            lo = start[row] + skip
            hi = np.minimum(lo + STRETCH + length - 1, end[row])
            for i, j in C.byte_slices(lo, hi, STRETCH):
                rows, g, d1, d2, first, n, probes = segments(raw, lo[i:j], hi[i:j], length, gram)
                rows = rows + i
                first = first + skip[rows]
                part = batch
                take = pa.array(row[rows])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(g), pa.array(d1), pa.array(d2), pa.array(first.astype(np.int64)), pa.array(n.astype(np.int64))]
                    + [pa.array(np.ascontiguousarray(probes[:, k])) for k in range(PARTS)],
                    names=["doc_id", "sig", "gram", "d1", "d2", "first", "n", *(f"p{k}" for k in range(PARTS))],
                )

    return run


def _cut_batches(length: int):
    """(doc_id, sig, text, wanted segments) -> the segments with their bytes."""
    import pyarrow as pa

    names = ["gram", "d1", "d2", "n", "splits"]

    def run(batches):
        for batch in batches:
            raw, start, end = C.string_spans(batch.column(0))
            want = batch.column(1)
            flat = want.flatten()
            sizes = np.diff(want.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            lo = start[row] + flat.field("first").to_numpy()
            hi = lo + flat.field("n").to_numpy() + length - 1
            step = 2000
            for k in range(0, len(lo), step):
                piece = flat.slice(k, step)
                yield pa.RecordBatch.from_arrays(
                    [piece.field(c) for c in names] + [pa.array([raw[a:b].tobytes() for a, b in zip(lo[k : k + step].tolist(), hi[k : k + step].tolist(), strict=True)], pa.binary())], names=[*names, "bytes"]
                )

    return run


def _runs(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).reshape(-1, 2)


def repeated_starts(texts: list[bytes], counts: np.ndarray, queries: list[bytes], query_counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags for the first counts[k] starts of each text (equal to another start of the texts) and query (equal to any)."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    valid = np.zeros(len(text), bool)
    offset = np.cumsum([0, *map(len, texts)])
    for o, c in zip(offset[:-1].tolist(), counts.tolist(), strict=True):
        valid[o : o + c] = True
    sa, group = suffix.suffix_array(text, length)
    lcp = suffix.kasai(text, sa, suffix.ranks(sa), length, group=group)
    own = np.flatnonzero(valid[sa])
    flags = np.zeros(len(text), bool)
    if len(own) > 1:
        # the least prefix from behind one start up to the next, over the suffixes between that aren't starts
        equal = np.minimum.reduceat(lcp[: own[-1] + 1], own[:-1] + 1) >= length
        flags[sa[own[:-1][equal]]] = True
        flags[sa[own[1:][equal]]] = True
    asked = np.zeros(0, bool)
    if queries:
        other = np.frombuffer(b"".join(queries), np.uint8)
        offset = np.cumsum([0, *map(len, queries)])
        at = np.concatenate([np.arange(o, o + c) for o, c in zip(offset[:-1].tolist(), query_counts.tolist(), strict=True)])
        asked = suffix.search_bytes(text, sa[own], other, at, length)
    return flags[valid], asked


def _shard(length: int):
    import pyarrow as pa

    def run(rows: pa.Table) -> pa.Table:
        own = np.array(rows.column("own").to_pylist(), bool)
        n = rows.column("n").to_numpy()
        data = rows.column("bytes").to_pylist()
        order = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
        k = int(own.sum())
        flags, asked = repeated_starts([data[i] for i in order[:k]], n[order[:k]], [data[i] for i in order[k:]], n[order[k:]], length)
        every = np.concatenate([flags, asked])
        at, runs = np.cumsum([0, *n[order]]), []
        for r in range(len(order)):
            runs.append(_runs(every[at[r] : at[r + 1]]).reshape(-1).tolist())
        got = rows.select(["gram", "d1", "d2"]).take(pa.array(order))
        return got.append_column("runs", pa.array(runs, pa.list_(pa.int64()))).filter(pa.array([bool(r) for r in runs]))

    return run


def _remove_batches(length: int, with_bytes: bool):
    import pyarrow as pa

    schema = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_bytes

    def run(batches):
        for batch in batches:
            raw, start, end = C.string_spans(batch.column(1))
            for i, j in C.byte_slices(start, end):
                part, out = batch.slice(i, j - i), []
                for s, e, found in zip(start[i:j].tolist(), end[i:j].tolist(), part.column(2).to_pylist(), strict=True):
                    text, spans = raw[s:e].tobytes(), []
                    pairs = sorted((f["first"] + a, f["first"] + b - 1 + length) for f in found or [] for a, b in zip(f["runs"][::2], f["runs"][1::2], strict=True))
                    for a, b in pairs:
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    edge = [0, *(x for p in spans for x in p), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                    out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if with_bytes else None))
                cols = list(zip(*out, strict=True))
                got = [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(got + [pa.array(cols[5], pa.binary())] * with_bytes, names=schema)
        C.release()

    return run


def repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 24, shard_bytes: int = SHARD_BYTES, with_bytes: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the bytes left).

    Texts are UTF-8 bytes; null is empty; strings don't cross documents. Strings are judged on the input, so
    all copies of a repeated string go. Rows that repeat an id are held against each other like any others, and
    so are rows without an id, which stays null. An empty table gives an empty result; other columns play no part.
    """
    given = F.col("doc_id").cast("long")
    src = docs.select(given.alias("given"), F.coalesce(given, F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))
    long_ = src.where(F.octet_length("text") >= length)
    seg = C.materialise(long_.select("doc_id", "sig", "text").mapInArrow(_segment_batches(length, gram), "doc_id long, sig long, gram long, d1 long, d2 long, first long, n long" + "".join(f", p{k} long" for k in range(PARTS))), "segments")
    often = seg.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    every, seg = seg, C.materialise(seg.join(often, "gram"), "shared-segments")
    C.drop_scratch(every)
    place = F.struct("doc_id", "sig", "first", "n")
    probes = [f"p{k}" for k in range(PARTS)]
    kinds = seg.groupBy("gram", "d1", "d2").agg(F.count("*").alias("c"), F.min(place).alias("a"), F.max(place).alias("b"), *[F.first(p).alias(p) for p in probes])
    every_kind = kinds = C.materialise(kinds, "kinds")
    probed = kinds.select("gram", "d1", "d2", "c", F.explode(F.array(*probes)).alias("probe")).where("probe <> 0")
    again = probed.groupBy("probe").agg(F.sum("c").alias("all_c")).where("all_c > 1").select("probe")
    alive = probed.join(again, "probe").select("gram", "d1", "d2").distinct()
    kinds = kinds.drop(*probes).join(alive, ["gram", "d1", "d2"], "left_semi")
    every, kinds = every_kind, C.materialise(kinds, "alive")
    C.drop_scratch(every)
    lone = kinds.groupBy("gram").agg(F.min("c").alias("least")).where("least = 1").select("gram")
    picked = C.materialise(kinds.join(lone, "gram", "left_semi").select("gram", "d1", "d2", "c", "a.*"), "picked")
    size = picked.agg(F.sum(F.col("n") + length)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    heavy = picked.groupBy("gram").agg(F.ceil(F.sum(F.col("n") + length) / F.lit(shard_bytes)).cast("int").alias("splits")).where("splits > 1")
    wanted = picked.join(heavy, "gram", "left").groupBy("doc_id", "sig").agg(F.collect_list(F.struct("gram", "d1", "d2", "n", F.coalesce("splits", F.lit(1)).alias("splits"), "first")).alias("want"))
    cut = long_.join(wanted, ["doc_id", "sig"]).dropDuplicates(["doc_id", "sig"]).select("text", "want").mapInArrow(_cut_batches(length), "gram long, d1 long, d2 long, n long, splits int, bytes binary")
    dealt = (
        cut.withColumn("shard", F.pmod(F.xxhash64("gram", F.lit("shard")), F.lit(shards)))
        .withColumn("home", F.pmod(F.xxhash64("d1", "d2", F.lit("home")), F.col("splits")))
        .withColumn("split", F.explode(F.expr("sequence(0, splits - 1)")))
        .withColumn("own", F.col("split") == F.col("home"))
        # a split gram has shards of its own
        .withColumn("shard", F.when(F.col("splits") > 1, F.xxhash64("gram", "split")).otherwise(F.col("shard")))
    )
    found = repeats = C.materialise(
        dealt.select("shard", "gram", "d1", "d2", "own", "n", "bytes").groupBy("shard").applyInArrow(_shard(length), "gram long, d1 long, d2 long, runs array<long>"), "repeats"
    )
    several = kinds.where("c > 1").select("gram", "d1", "d2", F.array(F.lit(0).cast("long"), F.col("a.n")).alias("runs"))
    found = found.unionByName(several).groupBy("gram", "d1", "d2").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    hits = seg.drop(*probes).join(found, ["gram", "d1", "d2"]).select("doc_id", "sig", F.struct("first", "runs").alias("f")).distinct().groupBy("doc_id", "sig").agg(F.collect_list("f").alias("found"))
    hits = C.materialise(hits, "hits")
    C.drop_scratch(seg, kinds, picked, repeats)
    out = src.join(hits, ["doc_id", "sig"], "left").select(F.col("given").alias("doc_id"), "text", "found")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    return out.mapInArrow(_remove_batches(length, with_bytes), schema + ", kept binary" * with_bytes)
