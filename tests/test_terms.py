"""Terms, sentences, lexicons and reaction groups by hand cases."""

import re

from pyspark.sql import functions as F

from lodestone.functions import terms
from lodestone.operators import lexicon, reaction_groups


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_aliases_and_parts(spark):
    assert column(spark, ["E. coli and S cerevisiae", "C. glutamicum", None, ""], "string", terms.with_aliases) == ["escherichia coli and saccharomyces cerevisiae", "corynebacterium glutamicum", None, ""]
    assert column(spark, ["E coli plants, Human", None], "string", lambda c: terms.without_parts(c, terms.ORGANISM_PARTS)) == ["e  s, ", None]
    assert column(spark, ["nothing, Lactic"], "string", lambda c: terms.without_parts(c, terms.OTHER_PARTS)) == ["hing, "]


def test_product_terms(spark):
    lists = [["pure bioethanol", "cell growth", "adhE genes", "Growth of x  y", "human", None, "three"], ["pure"], [], None]
    assert column(spark, lists, "array<string>", terms.product_terms) == [["ethanol", "biomass", "adhE", "of x y"], None, None, None]


def test_trimmed_products(spark):
    items = ["march 3, 2001", ">~units-12", "[ 4 ]", "(12-units-1%)", "VOL 3", "Production", "industrial ethanol", "ethanol fermentations", "active variant x supplement", "stable element", "", " ethanol ", None]
    got = column(spark, [items, [], None], "array<string>", terms.trimmed_products)
    told = [(x.product, [(e.value, e.reason) for e in x.log]) for x in got[0]]
    end = terms.NOTHING_LEFT
    assert told[:5] == [(None, [(i, r)]) for i, r in zip(items[:5], ["date-like", "plain-number", "bracketed-number", "bracketed-number", "vol-number"])]
    assert told[5] == (None, [("Production", terms.LEADING), ("Production", end)]) and told[6] == ("ethanol", [("industrial", terms.LEADING)])
    assert told[7] == ("ethanol", [("fermentations", terms.TRAILING)]) and told[8] == ("active variant x", [("supplement", terms.TRAILING)])
    assert told[9] == (None, [("stable", terms.LEADING), ("element", terms.TRAILING), ("stable element", end)])
    assert told[10] == (None, [("", end)]) and told[11] == ("ethanol", []) and told[12] == (None, []) and got[1:] == [[], None]


def plain_sentences(text):
    out = []
    if text:
        parts = re.split("|".join(terms.SENTENCE_ENDS), text)
        for p in parts[:-1] if parts[-1] == "" else parts:
            out += re.split("|".join(terms.STRAY_ENDS), p)
    return out


def test_sentences(spark):
    texts = ["E. coli grew. It was fast (very). yes: no. then Å. x", "one. two", "a . b ., c", "", None, "x]. 3 y.", "end.\n", ".", "a.b. C. D"]
    assert column(spark, texts, "string", terms.sentences_of) == [plain_sentences(t) for t in texts]


def plain_clauses(sentences):
    def cut(values, marks):
        out = {}
        for s in values:
            for p in re.split("|".join(marks), s):
                p = p.strip(" .,")
                if len(p.split()) > 1:
                    out.setdefault(p)
        return list(out)

    return cut(cut(sentences, terms.CLAUSE_MARKS), terms.CLAUSE_WORDS)


def test_clauses(spark):
    lists = [["adhE was deleted by us . the strain which grew rapidly was fast", "one", "x y ; x y", "a b. the c d", "it has been shown that x y"], [], [""]]
    assert column(spark, lists, "array<string>", terms.gene_clauses) == [plain_clauses(x) for x in lists]


def test_lexicon(spark):
    texts = spark.createDataFrame([(1, "A small  dog 12 Small a", 0), (2, None, 0), (3, "", 0), (4, "small", 0)], "article int, text string, word int")
    words = spark.createDataFrame([("small",), ("small",), ("12",), (None,), ("",)], "word string")
    ask = lambda **kw: {r.article: r.text for r in lexicon.without_lexicon(texts, words, **kw).collect()}
    assert ask() == {1: "A dog Small a", 2: None, 3: "", 4: ""}
    assert ask(fold=True, numbers=False)[1] == "A dog 12 a"
    assert {r.text for r in lexicon.without_lexicon(texts, words.limit(0)).collect()} == {"A small dog 12 Small a", None, "", "small"}


def test_reaction_groups(spark):
    rows = [(2, "b", "c1", "X", ["r1"], ["2", "1"]), (1, "a", None, "X", ["r2"], ["3"]), (3, "a", "c2", "X", None, ["1", "2", "2"]), (3, "a", "c2", "Y", ["r1"], None), (4, "q", "c", None, ["r"], ["1"])]
    chosen = spark.createDataFrame(rows, "paper int, gene string, class string, xref string, ids array<string>, ecs array<string>")
    lived = spark.createDataFrame([(2, "o2"), (3, "o1"), (3, "o1"), (9, "o9")], "paper int, organism string")
    got = {r.grp: r for r in reaction_groups.reaction_groups(chosen, lived).collect()}
    assert set(got) == {"X_1", "X_2", "Y_1"} and got["X_1"].ec_key == "3" and got["X_1"].organisms == [] and got["X_1"].classes == []
    x = got["X_2"]
    assert (x.ec_key, x.genes, x.papers, x.classes, x.ids, x.organisms, x.n_papers, x.share) == ("1,2", ["a", "b"], [2, 3], ["c1", "c2"], ["r1"], ["o1", "o2"], 2, 0.666667)
    assert got["Y_1"].ec_key == "" and got["Y_1"].share == 1.0
