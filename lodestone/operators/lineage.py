"""Lineage from a table of parent links, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def ancestors(nodes: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """(id, ancestor, depth) of every node and each of its ancestors; depth is 1 for the parent.

    nodes: id, parent. A root has no parent, or itself as one; a parent that isn't an id of the table is the last
    ancestor. Ids are distinct. Round k adds the ancestors at depths 2^k + 1 to 2^(k+1) by one equi-join of the
    ancestors so far with those at exactly 2^k, so a tree of depth d takes log2(d) rounds. A link that leads back
    to its own node raises ValueError: a cycle never runs out of ancestors, and then meets itself.
    """
    links = nodes.select("id", F.col("parent").alias("ancestor")).where(F.col("ancestor").isNotNull() & (F.col("ancestor") != F.col("id")))
    all_ = scratch.written(links.select("id", "ancestor", F.lit(1).cast("long").alias("depth")))
    reach = 1
    while True:
        far = all_.where(F.col("depth") == reach).select("id", F.col("ancestor").alias("at"))
        step = all_.select(F.col("id").alias("at"), F.col("ancestor"), F.col("depth"))
        more = scratch.written(far.join(step, "at").select("id", "ancestor", (F.col("depth") + reach).alias("depth")))
        if not more.where(F.col("id") == F.col("ancestor")).isEmpty():
            raise ValueError("the parent links hold a cycle")
        if more.isEmpty():
            return all_
        all_ = scratch.written(all_.unionByName(more))
        reach *= 2
        if reach > longest:
            raise ValueError(f"a lineage is longer than {longest}")


def lineage(nodes: DataFrame, ranks: tuple[str, ...]) -> DataFrame:
    """A row for each node: id, name, rank, a column for each rank with the name of the nearest node of that rank (itself first), path.

    nodes: id, parent, name, rank. path is the names from the root to the node, joined by "; ".
    """
    up = ancestors(nodes)
    who = nodes.select(F.col("id").alias("ancestor"), F.col("name").alias("a_name"), F.col("rank").alias("a_rank"))
    own = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    met = up.unionByName(own).join(who, "ancestor")
    found = met.groupBy("id").agg(
        *[F.min_by("a_name", F.when(F.col("a_rank") == r, F.col("depth"))).alias(r) for r in ranks],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "a_name")), asc=False), lambda s: s["a_name"]), "; ").alias("path"),
    )
    return nodes.select("id", "name", "rank").join(found, "id")
