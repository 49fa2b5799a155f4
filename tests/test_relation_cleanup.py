"""Relation cleanup by hand cases."""

from pyspark.sql import functions as F

from lodestone.operators import relation_cleanup as R


def told(spark, cases, f):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, g string")
    return [r[0] for r in df.select("i", f(F.col("s"), F.col("g")).alias("o")).orderBy("i").select("o").collect()]


def test_metabolites(spark):
    cases = [("x", "PEP"), ("glyceraldehyde-3-phosphate falls", "GAP"), ("GAP was deleted", "GAP"), ("the pool of (ATP) grew", "ATP"), ("ATP pool", "ATP"), ("level NADH", "NADH"), ("pool of GN1", "GN1")]
    assert told(spark, cases, R.is_metabolite) == [True, True, False, True, False, True, False]


def test_pathways(spark):
    cases = [("the TCA cycle", "TCA"), ("the (MVA) pathway", "MVA"), ("pathway [MVA]", "MVA"), ("MVA synthesis", "MVA"), ("the TCA cycle genes", "TCA"), ("ABC and TCA genes", "TCA"), ("ABC TCA genes", "TCA"), ("new, TCA genes", "TCA"), ("tca cycle", "tca"), ("TCA genes and TCA genes", "TCA"), ("A+B cycle", "A+B")]
    assert told(spark, cases, R.is_pathway) == [True, True, True, True, True, False, False, True, False, True, True]


def test_products(spark):
    cases = [("GABA production", "GABA"), ("GABA and PHB pool", "GABA"), ("(GABA) supply", "GABA"), ("ACO synthase (acs)", "ACO"), ("pyruvate (PYR) kinase", "PYR"), ("PYR-kinase", "PYR"), ("converting PYR fast", "PYR"), ("converting PYR gene", "PYR"), ("converting PYRUVATE", "PYRUVATE"), ("GABA was deleted", "GABA"), ("gaba production", "gaba")]
    assert told(spark, cases, R.is_product) == [True, True, True, True, True, True, True, False, False, False, False]


def test_denials(spark):
    cases = [
        ("x was not really induced", "was induced"),
        ("x was never overexpressed", "was overexpressed"),
        ("there were no deleted genes", "were deleted"),
        ("it was failed  to be deleted", "was deleted"),
        ("y was not seen, x was induced", "was induced"),
        ("x was induced and was not deleted", "was deleted"),
        ("it was induced, not then induced", "was induced"),
        ("x was not induced", "induction"),
        ("no was, not induced", "was induced"),
        ("never was it not never deleted", "was deleted strongly"),
    ]
    want = ["was not induced", "was never overexpressed", "no deleted", "failed to deleted", "was induced", "was not deleted", "was not induced", "induction", "was not induced", "was not strongly"]
    assert told(spark, cases, R.with_denial) == want


def test_own_name(spark):
    cases = [("a -> deletion of a", "x"), ("a -> a deletion", "x"), ("a -> deletion", "x"), ("ab -> a deletion", "x"), ("a-b -> a-b gone", "x")]
    assert told(spark, cases, lambda s, _: R.without_own_name(s)) == ["a -> deletion of", "a -> deletion", "a -> deletion", "ab -> a deletion", "a-b -> a-b gone"]


def test_cleaned(spark):
    rows = [(1, "PEP was deleted", "PEP -> was deleted"), (1, "x was not deleted", "x -> was deleted"), (1, "x was not deleted", "x -> was deleted"), (2, "ATP pool", "no relation"), (2, None, "x -> y"), (2, "s", None), (3, "s", "x -> x gone")]
    df = spark.createDataFrame(rows, "paper int, sentence string, relation string").withColumn("gene", F.lit(1))
    assert sorted(map(tuple, R.cleaned(df).collect())) == [(1, "x -> was not deleted"), (3, "x -> gone")]
    assert R.cleaned(df.limit(0)).count() == 0
