"""Centroid clustering by ball k-means, exact in integers.

A cluster is a ball: its centroid and the distance of its farthest member. A member that stands at d from its own
centroid can only be nearer to a centroid within 2 d of that one, so the balls of other centroids beyond twice the
radius are no neighbours at all; the members within half the way to the nearest neighbour are the stable core, which
needs no comparison, and the annuli around it are held against one neighbour more each. All bounds are compared in
squared integers, so nothing is lost to rounding and ties fall to the smaller number.

Vectors lie in blocks (one row of a table in the shared folder holds up to BLOCK vectors as bytes) that carry each
member's cluster from round to round. A round is one pass over the blocks, without a shuffle; each block also gives
the sums of its members by cluster, of which the driver gets one row a cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 2048
LIMIT = 1 << 26  # larger components are held to this, so that 4 * squared distance fits a long
_STATE = "ids array<long>, vectors binary, own binary, balls array<struct<c int, n long, inertia long, s array<long>>>"


def whole_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x) of the vectors with exactly dim components, none of them null or not finite; x in doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def reassign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, comparisons made) of every row of x, which lay in the clusters own.

    gaps holds the squared distances between centroids.
    """
    best, least, made = own.copy(), np.zeros(len(x), np.int64), 0
    for j in np.unique(own):
        rows = np.flatnonzero(own == j)
        d = ((x[rows] - centroids[j]) ** 2).sum(1)
        order = np.argsort(gaps[j], kind="stable")
        order = order[order != j]
        near = order[gaps[j][order] <= 4 * d.max()]
        # how many of the neighbours each member's annulus reaches; 0 is the stable core
        ring = np.searchsorted(gaps[j][near], 4 * d, side="right")
        b, bd = np.full(len(rows), j, own.dtype), d.copy()
        for r, i in enumerate(near):
            who = np.flatnonzero(ring > r)
            di = ((x[rows[who]] - centroids[i]) ** 2).sum(1)
            take = (di < bd[who]) | ((di == bd[who]) & (i < b[who]))
            b[who[take]], bd[who[take]] = i, di[take]
            made += len(who)
        best[rows], least[rows] = b, bd
    return best, least, made


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) by comparing all: for vectors that lie in no ball yet."""
    best, least = np.zeros(len(x), np.int32), None
    for i, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(1)
        if least is None:
            least = d
        else:
            take = d < least
            best[take], least[take] = i, d[take]
    return best, least


def _gaps(centroids: np.ndarray) -> np.ndarray:
    return np.stack([((centroids - c) ** 2).sum(1) for c in centroids])


def _balls(x, own, dist):
    return [{"c": int(j), "n": int((m := own == j).sum()), "inertia": int(dist[m].sum()), "s": x[m].sum(0).tolist()} for j in np.unique(own)]


def ball_kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold null or non-finite components are left out; components are
    floor(scale * x), held to LIMIT either way. The k starting vectors are those of the smallest sha256 of
    "seed:vec_id" (a null id counts as "null"; rows that repeat an id rank by their components); with fewer vectors
    there are fewer clusters. Repeated rows are vectors of their own. An inertia beyond a long is null. Other
    columns play no part. An empty table gives an empty result.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    kept = whole_vectors(vectors, dim)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    whole = lambda x: np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64)
    start = kept.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.stack([whole(np.array(r["x"])) for r in start])

    def state(ids, x, own, dist):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([x.astype("<i4").tobytes()], pa.binary()),
                pa.array([own.astype("<i4").tobytes()], pa.binary()),
                pa.array([_balls(x, own, dist)], pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("s", pa.list_(pa.int64()))]))),
            ],
            names=["ids", "vectors", "own", "balls"],
        )

    def first_pass(centroids):
        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(i, BLOCK)
                    x = whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    yield state(part.column(0).to_pylist(), x, *nearest(x, centroids))

        return run

    def next_pass(centroids, gaps):
        def run(batches):
            for batch in batches:
                for ids, v, o in zip(*(batch.column(c) for c in ("ids", "vectors", "own")), strict=True):
                    x = np.frombuffer(v.as_py(), "<i4").reshape(-1, dim).astype(np.int64)
                    own, dist, _ = reassign(x, np.frombuffer(o.as_py(), "<i4"), centroids, gaps)
                    yield state(ids.as_py(), x, own, dist)

        return run

    def balls(now):
        """One row a cluster that has members: its number, members, inertia and sums."""
        every = now.select(F.explode("balls").alias("b"))
        return every.groupBy("b.c").agg(F.sum("b.n").alias("n"), F.sum(F.col("b.inertia").cast("decimal(38,0)")).alias("inertia"), F.array(*[F.sum(F.col("b.s")[i]) for i in range(dim)]).alias("s")).collect()

    now = C.materialise(kept.mapInArrow(first_pass(centroids), _STATE), "balls-0")
    found = balls(now)
    for _ in range(rounds):
        after = centroids.copy()
        for r in found:
            after[r["c"]] = [s // r["n"] for s in r["s"]]
        if (after == centroids).all():
            break  # every further round would repeat this one
        centroids = after
        before, now = now, C.materialise(now.mapInArrow(next_pass(centroids, _gaps(centroids)), _STATE), "balls")
        C.drop_scratch(before)
        found = balls(now)

    long = lambda n: n if n < 1 << 63 else None
    inertia = {r["c"]: int(r["inertia"]) for r in found}
    total, by = long(sum(inertia.values())), [long(inertia.get(c, 0)) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def rows(batches):
        for batch in batches:
            for ids, v, o in zip(*(batch.column(c) for c in ("ids", "vectors", "own")), strict=True):
                x, own = np.frombuffer(v.as_py(), "<i4").reshape(-1, dim).astype(np.int64), np.frombuffer(o.as_py(), "<i4")
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, take, pa.array(((x - centroids[own]) ** 2).sum(1)), pa.array(by, pa.int64()).take(take), pa.array([total] * len(own), pa.int64()), pa.array(sha).take(take)],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return now.mapInArrow(rows, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def oracle_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in DuckDB's SQL: every round holds all vectors against all centroids."""
    digest = f"sha256('{seed}:' || coalesce(vec_id::varchar, 'null'))"
    parts = [
        f"""kept as materialized (select row_number() over () rid, vec_id, embedding::double[] x,
            list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) v from embeddings
            where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is null or not isfinite(e::double))) = 0)""",
        f"c0 as materialized (select (row_number() over (order by {digest}, x) - 1)::int c, v from kept order by {digest}, x limit {k})",
    ]
    for r in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
        parts.append(f"a{r} as materialized (select rid, min(struct_pack(d := {d}, c := c.c)) b from kept k cross join c{r} c group by rid)")
        if r < rounds:
            parts.append(
                f"""c{r + 1} as materialized (select o.c, coalesce(m.v, o.v) v from c{r} o left join (select c, list(m order by i) v from (
                    select c, i, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::bigint m from (
                    select b.c c, unnest(v) e, generate_subscripts(v, 1) i from a{r} join kept using (rid)) group by c, i) group by c) m on m.c = o.c)"""
            )
    last = f"a{rounds}"
    return f"""with {', '.join(parts)} select vec_id, b.c as cluster, b.d as distance,
        (sum(b.d) over (partition by b.c))::bigint as cluster_inertia, (sum(b.d) over ())::bigint as inertia,
        sha256(array_to_string(f.v, ',')) as centroid_sha256
        from {last} join kept using (rid) join c{rounds} f on f.c = b.c"""
