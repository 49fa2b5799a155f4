"""MinHash near-dedup: fast similarity sketching, banding, exact verification, connected groups.

A document's set holds its distinct k-word shingles (the whole sequence as one if it has fewer words).
The sketch has t coordinates. In round i < t every element goes to one hashed bin and each bin keeps its
smallest value; in round t + j all elements go to bin j. Rounds stop once all bins are filled, which holds
after 2t rounds at most, and coordinates agree with probability J, concentrated as in one-permutation
hashing. Bands of r coordinates give the candidates; each is confirmed on the full sets.

Documents with equal sets form one class whose smallest id stands for it. In each bucket all classes are
first held against the smallest one; components then drop out all pairs that are already connected, and
only pairs of different components are held against each other. That is done inside tasks, in blocks of
bounded size: coordinates (eight bits of each of `wide`) tell which classes may have a similar partner, as
their estimate comes within SPREAD standard deviations of the threshold; only these travel with their whole
sets, and each block returns a forest of exactly confirmed links. So a large group of near copies costs
links in proportion to its size, and no pairs are made into rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK, BLOCK_BYTES = 1024, 4_000_000
SPREAD = 4.75  # standard deviations
SPACE = C.byte_table(lambda b: b == 0x20 or 9 <= b <= 13)
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(raw, start, end, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), sorted by row then hash, distinct, for the rows of a slice."""
    w, wb, we = C.words_of(raw, start, end, SPACE)
    n = we - wb
    rows, values = [], []
    if len(w) >= k:
        count = len(w) - k + 1
        s = np.zeros(count, np.uint64)
        for j in range(k):
            s += w[j : j + count] * _K[j % 8] * np.uint64(2 * (j // 8) + 1)
        full = np.maximum(n - k + 1, 0)
        row = np.repeat(np.arange(len(n)), full)
        at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(wb, full)
        rows.append(row)
        values.append(C.mix64(s[at]))
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        if len(few):
            s = np.full(len(few), m, np.uint64) * np.uint64(0x9FB21C651E98DF25)
            for j in range(m):
                s += w[wb[few] + j] * _K[j % 8] * np.uint64(2 * (j // 8) + 1)
            rows.append(few)
            values.append(C.mix64(s))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def sketch(row: np.ndarray, value: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """t coordinates for each row that has elements (others stay at the largest value)."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_rows * t, top, np.uint64)
    live_row, live = row, value
    for i in range(2 * t):
        if not len(live):
            break
        h = C.mix64(live + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bins = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(live), i - t)
        key = live_row * t + bins
        empty = out[key] == top
        key, h = key[empty], C.mix64(h[empty]) >> np.uint64(1)
        np.minimum.at(out, key, h)
        if i < 4 or i % 16 == 0:
            open_rows = (out.reshape(n_rows, t) == top).any(1)
            keep = open_rows[live_row]
            live_row, live = live_row[keep], live[keep]
    return out.reshape(n_rows, t)


def _sketch_batches(k: int, t: int, r: int, wide: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw, start, end = C.string_spans(batch.column(1))
            for i, j in C.byte_slices(start, end):
                m = j - i
                row, value = shingle_sets(raw, start[i:j], end[i:j], k)
                n = np.bincount(row, minlength=m).astype(np.int64)
                first = np.cumsum(n) - n
                has = np.flatnonzero(n)
                ids = np.zeros((2, m), np.uint64)
                if len(has):
                    for q, salt in enumerate((0x1234567, 0x89ABCDEF1)):
                        ids[q, has] = np.add.reduceat(C.mix64(value + np.uint64(salt)), first[has])
                # each row's rank among those with elements keeps the sketch table small
                rank = np.cumsum(n > 0) - 1
                coords = sketch(rank[row], value, len(has), wide)
                low = (coords & np.uint64(255)).astype(np.uint8)
                brief = iter([x.tobytes() for x in low])
                coords = coords[:, :t]
                bands = np.zeros((len(has), t // r), np.uint64)
                for c in range(r):
                    bands = C.mix64(bands * np.uint64(0x9E3779B97F4A7C15) + coords[:, c::r][:, : t // r])
                bands = C.mix64(bands + np.arange(t // r, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                size = np.where(n > 0, t // r, 0)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, m),
                        pa.array(n),
                        pa.array(ids[0].view(np.int64)),
                        pa.array(ids[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64))),
                        pa.array([next(brief) if x else None for x in n.tolist()], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "brief"],
                )

    return run


def _verify_batches(k: int, num: int, den: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ra, sa, ea = C.string_spans(batch.column(2))
            rb, sb, eb = C.string_spans(batch.column(3))
            both = (ea - sa) + (eb - sb)
            for i, j in C.byte_slices(np.zeros(len(both), np.int64), both):
                m = j - i
                row_a, va = shingle_sets(ra, sa[i:j], ea[i:j], k)
                row_b, vb = shingle_sets(rb, sb[i:j], eb[i:j], k)
                row, v = np.concatenate([row_a, row_b]), np.concatenate([va, vb])
                order = np.lexsort((v, row))
                row, v = row[order], v[order]
                same = (row[1:] == row[:-1]) & (v[1:] == v[:-1])
                shared = np.bincount(row[1:][same], minlength=m)
                union = np.bincount(row, minlength=m) - shared
                ok = pa.array((shared > 0) & (den * shared >= num * union))
                part = batch.slice(i, m).select(["a", "b"])
                yield part.filter(ok)

    return run


class _Block:
    """Classes of one bucket, in blocks lo and hi: which pairs of different components may be similar."""

    def __init__(self, rows, num: int, den: int, wide: int):
        self.rep, self.comp, self.block = (rows.column(c).to_numpy() for c in ("rep", "component", "block"))
        self.lo, self.hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        self.brief = np.frombuffer(b"".join(rows.column("brief").to_pylist()), np.uint8).reshape(-1, wide)
        j = num / den
        self.least = wide * (j - SPREAD * np.sqrt(j * (1 - j) / wide))

    def close(self):
        """(row, rows that may be similar to it, likeliest first)."""
        own, other = np.flatnonzero(self.block == self.lo), np.flatnonzero(self.block == self.hi)
        for i in own.tolist():
            to = other[(self.comp[other] != self.comp[i]) & (self.rep[other] > self.rep[i] if self.lo == self.hi else True)]
            agree = (self.brief[to] == self.brief[i]).sum(1)
            near = np.flatnonzero(agree >= self.least)
            if len(near):
                yield i, to[near[np.argsort(-agree[near], kind="stable")]]


def _near_rows(num: int, den: int, wide: int):
    """(key, rep) of the classes with a partner that may be similar, in another component of the bucket."""
    import pyarrow as pa

    def run(rows: pa.Table) -> pa.Table:
        block = _Block(rows, num, den, wide)
        mark = np.zeros(len(block.rep), bool)
        for i, near in block.close():
            mark[i] = mark[near] = True
        return rows.select(["key", "rep"]).filter(pa.array(mark))

    return run


def _forest(num: int, den: int, wide: int):
    """Links between components, confirmed on full sets: as many as join what can be joined, at most one less than components."""
    import pyarrow as pa

    def run(rows: pa.Table) -> pa.Table:
        block = _Block(rows, num, den, wide)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("elements").to_pylist()]
        root, links = {}, []

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for i, near in block.close():
            for k in near.tolist():
                a, b = find(int(block.comp[i])), find(int(block.comp[k]))
                if a == b:
                    continue
                shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if den * shared >= num * (len(sets[i]) + len(sets[k]) - shared):
                    root[max(a, b)] = min(a, b)
                    links.append(sorted((int(block.rep[i]), int(block.rep[k]))))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _set_batches(k: int):
    """doc_id and its whole set, as sorted hashes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw, start, end = C.string_spans(batch.column(1))
            for i, j in C.byte_slices(start, end):
                row, value = shingle_sets(raw, start[i:j], end[i:j], k)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                out = [value[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, pa.binary())], names=["rep", "elements"])

    return run


def _in_blocks(rows: DataFrame, size, limit: int) -> DataFrame:
    """Each bucket in blocks of about limit by size; a row goes to every pair of blocks that its own is in."""
    total = rows.groupBy("key").agg(F.ceil(F.sum(size) / F.lit(limit)).cast("int").alias("blocks"))
    return (
        rows.join(total, "key")
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("blocks", "other")
    )


def near_duplicates(
    docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), t: int = 128, r: int = 4, wide: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept.

    threshold (num, den): documents are linked when den * intersection >= num * union. Null and wordless
    texts have empty sets and link with nothing. Rows without an id link with nothing, have no component and
    are kept. Repeated rows of one id count as one document's copies.
    Other columns of docs play no part. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = C.materialise(
        src.mapInArrow(_sketch_batches(k, t, r, wide), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, brief binary"), "sketch"
    )
    classes = sk.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = sk.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    buckets = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")).distinct()
    lead = buckets.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    cand = C.materialise(buckets.join(lead, "key"), "candidates")
    # the texts of all candidates, once; the other texts aren't moved again
    texts = C.materialise(
        src.join(cand.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts"
    )

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(
            texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a"
        )
        return C.materialise(full.select("a", "b", "ta", "tb").mapInArrow(_verify_batches(k, *threshold), "a long, b long"), name)

    first = cand.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(first, "links-1")
    comp = C.materialise(C.with_component(cand, "rep", C.connected_components(links)), "grouped")
    # buckets of the same classes need one look; so do those of one component none
    mixed = comp.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    mixed = mixed.where("lo < hi").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    brief = sk.select(F.col("doc_id").alias("rep"), "brief").where("rep is not null").groupBy("rep").agg(F.max("brief").alias("brief"))
    open_ = C.materialise(comp.join(mixed, "key").select("key", "rep", "component").join(brief, "rep"), "open")
    near = _in_blocks(open_, F.lit(1), BLOCK).groupBy("key", "lo", "hi").applyInArrow(_near_rows(*threshold, wide), "key long, rep long")
    near = C.materialise(near.distinct(), "near")
    sets = texts.join(near.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_set_batches(k), "rep long, elements binary")
    full = C.materialise(near.join(open_, ["key", "rep"]).join(sets, "rep"), "near-sets")
    links2 = _in_blocks(full, F.octet_length("elements"), BLOCK_BYTES).groupBy("key", "lo", "hi").applyInArrow(_forest(*threshold, wide), "a long, b long")
    links = links.unionByName(C.materialise(links2, "links-2"))
    comps = C.connected_components(links)
    groups = C.materialise(C.with_component(classes, "rep", comps, "component_id"), "groups")
    C.drop_scratch(cand, texts, comp, open_, near, full, links)
    return (
        sk.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(groups.select("set_a", "set_b", "n_shingles", "component_id"), ["set_a", "set_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs whose document stays: one of each group, and all that link with nothing."""
    kept = near_duplicates(docs, **kw).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
