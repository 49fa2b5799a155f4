"""What stands together in the lines of an order, and lists whose order ties."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import reaction_groups, together
from lodestone.plans import catalog


@pytest.mark.parametrize("name", ["AGG2", "AGG5", "ARR10", "ARR18"])
def test_ties_stand_as_in_the_file(spark, tmp_path, name):
    """Lines a million part keys and one line number apart tie, and DuckDB leaves them as it reads them."""
    # (1, 1000004) and (2, 4) tie; the value alone would put 4 first
    rows = [(7, 2, 500), (7, 1, 1000004), (7, 2, 4), (7, 1, 6), (8, 3, 4), (8, 2, 1000004), (8, 1, 2000004), (9, 1, 2000004), (9, 2, 1000004), (9, 3, 4)]
    path = f"{tmp_path}/lineitem.parquet"
    duck = duckdb.connect(config={"threads": 1})
    duck.sql("create table t (l_orderkey bigint, l_linenumber int, l_partkey bigint)")
    duck.executemany("insert into t values (?, ?, ?)", rows)
    duck.sql(f"copy t to '{path}' (format parquet)")
    duck.sql(f"create view lineitem as select * from '{path}'")
    want = {r[0]: r[1] for r in duck.sql(catalog.ORACLE[name]).fetchall()}
    assert {r[0]: r[1] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_pairs_without_a_self_join(spark):
    """pairs were made by a join and counted in the same task, which held all of them."""
    df = spark.createDataFrame([(1, 10, 5), (1, 10, 6), (1, 11, 5), (2, 10, 5), (2, None, 7), (None, 10, 9), (3, 12, None)], "o long, s long, p long")
    n = together.counted(df, "o", "s", "p")
    got = {(r.left, r.right): r.n for r in n.collect()}
    assert got == {(10, 5): 2, (10, 6): 1, (11, 5): 1, (11, 6): 1, (None, 5): 1, (None, 7): 1, (10, 7): 1, (12, None): 1}
    assert {r.left: r.reach for r in together.reach(df, "o", "s").collect()} == {10: [10, 11], 11: [10, 11], 12: [12], None: [10]}
    for out in (n, together.reach(df, "o", "s"), catalog.QUERIES["JN5"](spark, "/root/testdata/sf0.001"), catalog.QUERIES["AGG16"](spark, "/root/testdata/sf0.001")):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_rows(spark):
    assert together._tasks(spark.range(10)) == 8
    assert together._tasks(spark.range(9 * together.ROWS_A_TASK + 1).where(F.col("id") >= 0)) == 10


def test_reactions_are_chosen_once(spark):
    """groups, organisms and totals each chose the reactions anew."""
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    chosen = spark.createDataFrame([(1, "g", "a", "X", ["i"], ["1.1.1.1"]), (2, "h", "b", "X", None, ["2.1.1.1"])], "paper long, gene string, class string, xref string, ids array<string>, ecs array<string>")
    chosen = chosen.withColumn("xref", F.udf(seen, "string")("xref").alias("xref"))
    out = reaction_groups.reaction_groups(chosen, spark.createDataFrame([(1, "o")], "paper long, organism string")).collect()
    assert sorted((r.grp, r.ec_key, r.organisms, r.share) for r in out) == [("X_1", "1.1.1.1", ["o"], 0.5), ("X_2", "2.1.1.1", [], 0.5)]
    # once to leave nulls out, once as a value
    assert calls.value <= 4
