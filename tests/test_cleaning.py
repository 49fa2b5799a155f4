"""Literal results of the rule tables, by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import cleaning, phrases, text

CASES = {
    "greek_names": {"βcarotene": "betacarotene", "Δ9 ß-x": "delta9 beta-x", "plain": "plain"},
    "canonical_name": {
        "(R)-Lactic acid": "lacticacid", "L-lysine": "lysine", "(+)-Limonene": "limonene", "β-carotene": "carotene", "beta-Carotene": "carotene", "2,3-butanediol": "butanediol",
        "trans-Cinnamic acid": "cinnamicacid", "rac-lactide": "lactide",
    },
    "family_name": {"polyhydroxyalkanoates": "pha", "polyhydroxybutyrate": "phb", "polyhydroxybutyratecohydroxyvalerate": "phbv", "wax": "wax"},
    "unit_marks": {"5 g/L": "5-units", "12mg/l": "12-units", "3 mmol": "3-units", "(20%)": "units", "wax": "wax"},
    "chemical_words": {"glucose and ethene": "glucchemical and ethchemical", "yeast": "yeast"},
    "simpler_phrases": {"mutation in the coding gene": "mutated the gene", "over-expressed and another": "overexpressed and", "relative transcriptional levels of x": "the expression of x"},
    "without_reference_marks": {"as shown [1, 2] by x": "as shown by x", "a\n b": "a b"},
    "without_citations": {"DOI 10.1038/123 x": " x", "see www.foo.org/abc rest": "see ", "Published: 12 May 2020 x": " x", "plain text": "plain text"},
}


@pytest.mark.parametrize("name", CASES)
def test_tables(spark, name):
    cases = CASES[name] | {None: None}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(getattr(cleaning, name)(F.col("c"))).collect()] == list(cases.values())


def test_roots_and_clauses(spark):
    df = spark.createDataFrame([("highly efficient-x cell",), (None,)], "c string")
    assert [r[0] for r in df.select(cleaning.without_roots(F.col("c"), ["effic"])).collect()] == ["highly  cell", None]
    df = spark.createDataFrame([("the red cell",), ("the quickly",), ("red cells, mostly",), ("red",)], "c string")
    assert [r[0] for r in df.select(cleaning.trimmed_clause(F.col("c"), ["the"])).collect()] == ["red cell", "", "red cells", "red"]


def test_gene_phrases(spark):
    cases = {
        "genes of the pathway (abcD) and its twin (efgH) grew": "genes of abcD and efgH grew",
        "gene of degradation (abcD)": "genes of abcD",
        "the very new kinase gene (abcD)": "the abcD gene",
        "the kinase (abcD) gene": "the abcD gene",
        "the kinase genes": "the genes",
        "the native kinase gene": "the kinase",
        "plain": "plain",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(phrases.gene_phrases(F.col("c"))).collect()] == list(cases.values())


def test_sections(spark):
    df = spark.createDataFrame([("a\nReferences\nb\nReferences\nc",), ("Acknowledgements x",), ("none",), (None,)], "c string")
    assert [r[0] for r in df.select(text.cut_at(F.col("c"), cleaning.END_SECTIONS)).collect()] == ["a\n", "", "none", None]
