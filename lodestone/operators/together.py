"""What stands together in the rows of one group: pairs of values without a self-join, and values as lists in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that one task takes, so that what a task holds does not grow with the table.
ROWS_A_TASK = 400_000


def _tasks(rows: DataFrame, least: int = 8) -> int:
    return max(least, -(-rows.count() // ROWS_A_TASK))


def pairs(rows: DataFrame, group: str, left: str, right: str) -> tuple[DataFrame, int]:
    """(left, right) for each group and distinct pair of its values, nulls among them, and the number of tasks to deal them to.

    A group's rows are gathered once and pair off in their row; rows without a group pair with nothing.
    """
    tasks = _tasks(rows)
    one = rows.where(F.col(group).isNotNull()).select(group, F.struct(F.col(left).alias("l"), F.col(right).alias("r")).alias("v")).repartition(tasks, group).groupBy(group).agg(F.collect_list("v").alias("v"))
    sides = one.select(F.array_distinct("v.l").alias("l"), F.array_distinct("v.r").alias("r"))
    return sides.select(F.explode("l").alias("left"), "r").select("left", F.explode("r").alias("right")), tasks


def counted(rows: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """(left, right, n): in how many groups both stand."""
    both, tasks = pairs(rows, group, left, right)
    # nearly all pairs are rare, so none is counted before it is dealt out
    return both.repartition(tasks, "left", "right").groupBy("left", "right").agg(F.count("*").alias("n"))


def reach(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(left, reach): the sorted distinct values that share a group with a value, itself included."""
    both, tasks = pairs(rows, group, value, value)
    return both.repartition(tasks, "left").groupBy("left").agg(F.array_sort(F.collect_set("right")).alias("reach"))


def in_file_order(table: DataFrame, group: str, value: Column, by: Column) -> DataFrame:
    """(group, values): the values of a group by an order; those that tie stand as in the file of table, which is read from files."""
    rows = table.select(group, F.struct(by.alias("by"), F.col("_metadata.row_index").alias("at"), value.alias("v")).alias("e"))
    return rows.groupBy(group).agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["v"]).alias("values"))
