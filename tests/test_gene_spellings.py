"""Genes by their spellings."""

from lodestone.operators import genes


def test_first_spelling_is_told_in_one_grouping(spark):
    """what was found was joined with itself, which broadcast it through the driver."""
    tokens = spark.createDataFrame([(1, 0, "adhE"), (1, 1, "ADHE"), (2, 0, "adhe"), (3, 0, "x"), (4, 0, "")], "article int, pos int, token string")
    out = genes.find(tokens, spark.createDataFrame([("adhE",), ("ADHE",)], "gene string"))
    assert {r.article: (r.genes, r.step) for r in out.collect()} == {1: (["ADHE", "adhE"], 0), 2: (["ADHE"], 2)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
