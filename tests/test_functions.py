import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import arrays, text
from lodestone.functions.rules import Rule, first_match, rewrite
from lodestone.operators import genes, organisms, relations, similar
from lodestone.sources import readers, writers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_rules_are_ordered(spark):
    rules = [Rule("a", "b"), Rule("b+", "c"), Rule(".", "!", True)]
    strings = ["", "aab.", "xyz", "b.a", None]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    want = [None if s is None else re.sub("b+", "c", s.replace("a", "b")).replace(".", "!") for s in strings]
    assert [r[0] for r in df.select(rewrite(F.col("s"), rules)).collect()] == want
    cases = [("a", "first"), ("b", "second")]
    assert [r[0] for r in df.select(first_match(F.col("s"), cases, F.lit("none"))).collect()] == ["none", "first", "none", "first", "none"]


def test_porter():
    # fixed values: examples of the published algorithm
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustable": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate", "cease": "ceas"}
    assert {w: text.Porter.stem(w) for w in pairs} == pairs


@settings(max_examples=300, deadline=None)
@given(a=st.text("ab", max_size=10), b=st.text("ab", max_size=10))
def test_greedy_is_symmetric_on_equal_lengths(a, b):
    assert similar.greedy_close(a, a)
    if len(a) == len(b):
        assert similar.greedy_close(a, b) == similar.greedy_close(b, a) == (sum(x != y for x, y in zip(a, b)) <= 3)


def test_close_names_finds_every_pair(spark):
    names = ["butanediol-14", "butanediol-23", "butandiol-14", "propanediol-1", "propanediole", "xxxxxxxxxxxx", "succinate acid", "succinat acid"]
    got = {tuple(r) for r in similar.close_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = {(a, b) for a in names for b in names if a < b and abs(len(a) - len(b)) <= 3 and similar.greedy_close(a, b)}
    assert got == want


def test_lists(spark):
    df = spark.createDataFrame([(["a", "A", "b", "a"], "x, X ,, y", [], ["ab", "abc", "zz"])], "l array<string>, s string, e array<string>, m array<string>")
    r = df.select(arrays.distinct_ignoring_case(F.col("l")), arrays.split_list(F.col("s")), arrays.null_if_empty(F.col("e")), arrays.without_contained(F.col("m")), arrays.directions(F.col("e"), ["up"]), arrays.bigrams(F.col("l"))).first()
    assert list(r) == [["a", "b"], ["x", "y"], None, ["abc", "zz"], ["Other"], ["a A", "A b", "b a"]]


def test_csv_cells(spark):
    cells = {"=1+1": '"\'=1+1"', 'a"b': '"a""b"', "\t-x": '"\'\t-x"', "plain": '"plain"'}
    df = spark.createDataFrame([(c,) for c in cells], "c string").select("c", text.csv_cell(F.col("c")).alias("v"))
    assert {r.c: r.v for r in df.collect()} == cells


def test_cascade_takes_the_first_source(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, None, "y"), (3, None, None)], "id int, title string, abstract string")
    out = organisms.cascade(df, ["title", "abstract"], lambda d, c: d.withColumn("v", F.col(c)), "v")
    assert sorted((r.id, r.v, r.v_source) for r in out.collect()) == [(1, "x", "title"), (2, "y", "abstract"), (3, None, "not_found")]


def test_genes(spark):
    d = spark.createDataFrame([("adhE",), ("LdhA",), ("PTA",)], "gene string")
    t = spark.createDataFrame([(1, 0, "adhE"), (1, 1, "pta"), (2, 0, "ldhA"), (2, 1, "pta"), (3, 0, "zzz")], "article int, pos int, token string")
    assert sorted((r.article, r.genes, r.step) for r in genes.find(t, d).collect()) == [(1, ["adhE"], 0), (2, ["LdhA"], 1)]
    pairs = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3)], "name string, entry int")
    assert {r.name: (r.names, r.entries) for r in genes.two_hop_dictionary(pairs).collect()} == {"a": (["a", "b"], [1, 2]), "b": (["a", "b", "c"], [1, 2]), "c": (["b", "c"], [1, 2]), "d": (["d"], [3])}


STEMS = {"was overexpressed": "overexpress", "deletion": "delet", "introduction": "introduct", "increasing the expression": "increas express", "not expressed": "not express", "removal of the gene": "remov", "was disrupted": "disrupt", "": "", "in the": "", "ease": "eas", "Blocks!": "blocks"}
DIRECTIONS = {
    "Positive": ["overexpress", "upregulat", "inducibl", "introduct", "not delet", "g -> Insert"],
    "Negative": ["delet", "lack", "lacks", "blocks", "not express", "repress express", "downregulat express", "inhibit express", "x -> no induc"],
    "Other": ["mutat", "regulat express", "modulat express", "overexpr", "not overexpr", "coregulat", "not regulat", ""],
}


def test_modification_stems(spark):
    df = spark.createDataFrame([*STEMS.items(), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(text.modification_stem(F.col("a"))).collect()] == [*STEMS.values(), None]


def test_relations(spark):
    df = spark.createDataFrame([(x, k) for k, v in DIRECTIONS.items() for x in v] + [(None, None)], "a string, b string")
    assert [(r.a, r.c) for r in df.select("a", relations.direction(F.col("a")).alias("c")).collect()] == [(r.a, r.b) for r in df.collect()]
    g = spark.createDataFrame([(1, "x", ["1.1.1.1", "2.-.-.-", "3.5"], ["was deleted", "seen"]), (1, "y", ["1.1"], ["deleted"]), (2, "z", None, None)], "paper int, gene string, ecs array<string>, actions array<string>")
    assert [(r.paper, r.gene, r.ecs, [tuple(m) for m in r.mods]) for r in relations.relevant(g).collect()] == [(1, "x", ["1.1.1.1"], [("delet", "Negative")])]


def test_published_checks(spark, tmp_path):
    df = spark.createDataFrame([("1", "2001"), ("2", "soon")], "PMID string, Year string")
    df.write.option("header", True).option("sep", ";").csv(f"file://{tmp_path}/p")
    with pytest.raises(ValueError, match="Title"):
        readers.published(spark, f"file://{tmp_path}/p", ["PMID", "Title"])
    with pytest.raises(Exception, match="bad year: soon"):
        readers.published(spark, f"file://{tmp_path}/p", ["PMID"]).collect()
    with pytest.raises(ValueError, match="no writer"):
        writers.save(df, f"file://{tmp_path}/x.bin")
