"""Texts without the words of a lexicon."""

from lodestone.operators import lexicon


def test_only_words_of_the_lexicon_are_gathered(spark):
    """the words that stay were gathered by text, which sorted and spilled every word of the corpus."""
    texts = spark.createDataFrame([(1, "a b  a c"), (2, "b b"), (3, None), (4, ""), (5, "x A")], "article long, text string")
    out = lexicon.without_lexicon(texts, spark.createDataFrame([("b",), ("a",), ("a",)], "word string"))
    assert {r[0]: r[1] for r in out.collect()} == {1: "c", 2: "", 3: None, 4: "", 5: "x A"}
    folded = lexicon.without_lexicon(texts, spark.createDataFrame([("a",)], "word string"), fold=True)
    assert {r[0]: r[1] for r in folded.collect()} == {1: "b c", 2: "b b", 3: None, 4: "", 5: "x"}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
