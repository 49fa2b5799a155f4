"""Embedding near-dedup: an exact metric range join over pivots.

Unit vectors stand at the angle acos(cosine), a metric. Each vector's home is the cell of the pivot nearest
to it; it is also sent to every other cell whose pivot is at most 2 * radius farther than its own (by the
triangle inequality no other cell can hold a neighbour) and at most radius beyond that cell's farthest
member. Cells of each label join independently, in blocks of bounded size, by matrix products: a home
vector is held against all vectors of its cell, so each link is counted once at either end. Blocks return
counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 2048


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which rows are usable)."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out, ok = np.zeros((len(vectors), width)), np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        x = np.zeros(width)
        x[: len(v)] = v
        top = np.abs(x).max() if len(x) else 0.0
        if not np.isfinite(top) or top == 0 or not np.isfinite(x).all():
            continue
        x /= top
        out[i], ok[i] = x / math.sqrt(float(x @ x)), True
    return out, ok


def _cells(pivots: np.ndarray, radius: float, reach: dict | None):
    """Home rows (reach None: cell, distance) or all placements (label, cell, home, vec_id, vector)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                x, _ = unit(part.column(2).to_pylist())
                width = max(x.shape[1], pivots.shape[1])
                x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                p = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
                angle = np.arccos(np.clip(x @ p.T, -1, 1))
                home = angle.argmin(1)
                near = angle[np.arange(len(x)), home]
                if reach is None:
                    yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(near)], names=["cell", "far"])
                    continue
                far = np.array([reach.get(c, -10.0) for c in range(len(p))])
                to = (angle <= near[:, None] + 2 * radius + 1e-6) & (angle <= far + radius + 1e-6)
                to[np.arange(len(x)), home] = True
                row, cell = np.nonzero(to)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[row], pa.int64()), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), pa.array(ids[row], pa.int64()), pa.array(list(x[row]), pa.list_(pa.float64()))],
                    names=["label", "cell", "home", "vec_id", "x"],
                )

    return run


def _join_block(cosine: float):
    import pyarrow as pa

    def run(rows: pa.Table) -> pa.Table:
        ids, home, block = (rows.column(c).to_numpy() for c in ("vec_id", "home", "block"))
        pair = rows.column("pair_lo")[0].as_py(), rows.column("pair_hi")[0].as_py()
        x = np.stack(rows.column("x").to_numpy())
        count, lead = np.zeros(len(ids), np.int64), np.arange(len(ids))
        sides = [(pair[0], pair[1])] if pair[0] == pair[1] else [pair, pair[::-1]]
        for a, b in sides:
            own, other = np.flatnonzero((block == a) & home), np.flatnonzero(block == b)
            for i in range(0, len(own), 512):
                sub = own[i : i + 512]
                s = x[sub] @ x[other].T
                near = np.abs(s - cosine) < 1e-9
                link = s >= cosine
                for r, c in zip(*np.nonzero(near), strict=True):
                    link[r, c] = math.fsum(x[sub[r]] * x[other[c]]) >= cosine
                link &= sub[:, None] != other[None, :]
                count[sub] += link.sum(1)
                # a spanning forest: every row's first neighbour, then rows whose neighbours lie in several groups
                for r in np.flatnonzero(link.any(1)):
                    to = other[link[r]]
                    roots = np.unique(np.append(_find(lead, to), _find(lead, sub[r : r + 1])))
                    lead[roots] = roots[0]
        top = _find(lead, np.arange(len(ids)))
        keep = (count > 0) | (top != np.arange(len(ids)))
        return pa.table({"vec_id": pa.array(ids[keep], pa.int64()), "n": pa.array(count[keep]), "peer": pa.array(ids[top][keep], pa.int64())})

    return run


def _find(lead: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = lead[at]
    while True:
        up = lead[out]
        if (up == out).all():
            lead[at] = out
            return out
        out = up


def near_vectors(table: DataFrame, cosine: float = 0.93, pivots: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable), kept.

    Vectors link if their labels are equal and not null and their cosine is at least the bound. Vectors that
    are null, zero or hold null or non-finite components, and those without a label or id, link with nothing; a
    vector of fewer dimensions counts as padded by zeros. Rows that repeat an id link like any others, and
    the id's row carries the links of all its rows. Rows without an id have no component and are kept. An empty table
    gives an empty result.
    """
    spark = table.sparkSession
    src = table.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    live = src.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").where(
        "forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v <> 0)"
    )
    n, labels = live.agg(F.count("*"), F.countDistinct("label")).first()
    radius = math.acos(cosine)
    if pivots is None:
        pivots = min(256, max(1, -(-n // (max(1, labels) * 4096))))
    # a bounded sample gives the pivots, each as far as can be from those before it
    sample, _ = unit([r[0] for r in live.select("embedding").orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(16 * pivots).collect()])
    chosen = [0]
    while len(sample) and len(chosen) < min(pivots, len(sample)):
        chosen.append(int((sample @ sample[chosen].T).max(1).argmin()))
    p = sample[chosen] if len(sample) else np.zeros((1, 1))
    homes = live.mapInArrow(_cells(p, radius, None), "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect()
    reach = {r[0]: r[1] for r in homes}  # one number per pivot, however many labels there are
    placed = C.materialise(live.mapInArrow(_cells(p, radius, reach), "label long, cell int, home boolean, vec_id long, x array<double>"), "placed")
    size = placed.groupBy("label", "cell").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = (
        placed.join(size, ["label", "cell"])
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("pair_lo", F.least("block", "other"))
        .withColumn("pair_hi", F.greatest("block", "other"))
    )
    found = C.materialise(
        dealt.select("label", "cell", "pair_lo", "pair_hi", "block", "home", "vec_id", "x").groupBy("label", "cell", "pair_lo", "pair_hi").applyInArrow(_join_block(cosine), "vec_id long, n long, peer long"),
        "found",
    )
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = C.connected_components(found.select(F.col("vec_id").alias("a"), F.col("peer").alias("b")))
    out = src.select("vec_id").join(links, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"))
    return C.with_component(out, "vec_id", comps, "component_id").withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
