"""Sections, raw text and the names of organisms by hand cases and plain versions."""

import re

from pyspark.sql import functions as F

from lodestone.functions import rawtext, sections
from lodestone.operators import taxa


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_back_matter(spark):
    chunks = [["Author contributions", "A. B."], ["Materials and methods", "The authors"], ["See supporting information", "x"], ["Supporting information", None], ["Results", "x", "funding"], [], None, ["Methods", "Funding"]]
    assert column(spark, chunks, "array<string>", sections.is_back_matter) == [True, False, False, True, False, False, False, True]


def test_heading_word(spark):
    assert column(spark, ["IV. Introduction to x", "2.1 BACKGROUND:", "", "12", None], "string", sections.heading_word) == ["introduction", "background", "", "", None]


def test_introduction(spark):
    many = "".join(f"S{i} is old. " for i in range(9))
    cases = [["Introduction. Old work. ", "In this study we grew cells. Then more."], ["1 Background. ", many], ["Results", "Introdution. One. Two."], ["Results", "x"], [], None]
    got = column(spark, cases, "array<string>", sections.introduction)
    assert got[0] == "In this study we grew cells. Then more."
    assert got[1] == " ".join(f"S{i} is old." for i in range(3, 9))[:-1] + "." and got[2] == "ResultsIntrodution. One. Two."
    assert got[3:] == [None, None, None]


def test_lines_and_primers(spark):
    texts = ["a\nb", "A\nb", "a\nB", "a\n\nb", "1\n2", None, ""]
    assert column(spark, texts, "string", sections.joined_lines) == [None if t is None else re.sub(r"(?<![A-Z])\n(?![A-Z])", " ", t) for t in texts]
    assert column(spark, ["see 5′-ACGTn-3′ and 5′AC3′, 5′-XY-3′"], "string", sections.without_primers) == ["see  and , 5′-XY-3′"]


def test_raw_text(spark):
    text = 'The ADH2 gene adhE in (E coli strain) Of (E coli strain) was A "B" at 2.5 fold, see http://x.org/a?b=1 and 10.1000/abc-1 [ ]. END'
    plain, gene = column(spark, [text], "string", lambda c: rawtext.raw_text(c))[0], column(spark, [text], "string", lambda c: rawtext.raw_text(c, gene=True))[0]
    assert plain.startswith("the adh2 gene adhe in (E-coli-strain) of (E-coli-strain)".lower().replace("(e-", "(E-")) and " A B at 25 fold" in plain and plain.endswith("end")
    assert "ADH2 gene adhE in" in gene and gene.endswith("END") and "http" not in gene and "10.1000" not in gene
    assert column(spark, [None, ""], "string", lambda c: rawtext.raw_text(c, gene=True)) == [None, ""]


def test_gene_sentences(spark):
    roots = ["express", "engineer", "robust"]
    got = column(spark, ["A robust strain expresses <i>adhE</i> frequently. The next one engineered it."], "string", lambda c: rawtext.gene_sentences(c, roots))[0]
    assert rawtext.gene_roots(roots) == ["frequen", "robust"]
    assert "robust" not in " ".join(got) and "expresses adhE" in got[0] and "frequently" not in got[0] and "engineered" in " ".join(got)


def test_species_table(spark):
    rows = [(1, "Candidatus Bacillus niger"), (2, "'[Bacillus] subtilis'"), (3, "Mixed culture x"), (4, "bacillus low"), (6, "Bacillus niger"), (5, "Bacillus"), (7, None), (8, "Candidatus of x")]
    got = {r.tax_id: (r.full_name, r.genus, r.species) for r in taxa.species_table(spark.createDataFrame(rows, "tax_id int, species string")).collect()}
    assert got == {1: ("Bacillus niger", "Bacillus", "B. niger"), 2: ("Bacillus] subtilis", "Bacillus", "B. subtilis'"), 5: ("Bacillus", "Bacillus", None)}


def test_name_words(spark):
    rows = [(1, "Engineered <i>Escherichia coli</i> coli BL-21 sp sp E of E x 12 12 Escherichia"), (2, None), (3, "of production"), (4, "")]
    texts = spark.createDataFrame(rows, "article int, text string")
    genera = spark.createDataFrame([("Escherichia",), ("Escherichia",), (None,), ("",)], "genus string")
    got = {r.article: r.words for r in taxa.name_words(texts, genera).collect()}
    assert got == {1: "Escherichia coli sp sp E E 12 12 Escherichia".replace("coli sp", "coli 21 sp").split(), 2: [], 3: [], 4: []}


def plain_names(text, names):
    low = {k.lower(): v for k, v in names.items()}
    pattern = re.compile(r"\b(" + "|".join(re.escape(k) for k in sorted(names, key=len, reverse=True)) + r")\b", re.I)
    return pattern.sub(lambda m: low[m[0].lower()], text)


def test_replace_names(spark):
    names = {"Pichia pastoris": "Komagataella phaffii", "Pichia": "Komagataella", "Ralstonia eutropha H16": "Cupriavidus necator H16", "eutropha": "necator", "pastoris gs": "P-GS", "x (y) z": "new"}
    texts = ["PICHIA pastoris gs115 and pichia, Ralstonia eutropha h16!", "ralstonia eutropha h1 eutropha", "none here", "", None, "pichia  pastoris pastoris GS.", "X (Y) z pichia_x pichia", "pichia pastoris pastoris gs " * 50]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "article int, text string, head int")
    table = spark.createDataFrame([*names.items(), (None, "q"), ("-bad", "q"), ("none", None)], "old string, new string")
    got = [r.text for r in taxa.replace_names(df, table).orderBy("article").collect()]
    assert got == [None if t is None else plain_names(t, names) for t in texts]
    assert taxa.replace_names(df.limit(0), table).count() == 0 and taxa.replace_names(df, table.limit(0)).where("text is null").count() == 1


def test_full_names(spark):
    lists = spark.createDataFrame([(1, ["E coli", "Bacillus subtilis", "C roseus", "X y"]), (2, ["X y"]), (3, None), (4, [])], "article int, organisms array<string>")
    known = spark.createDataFrame([("Escherichia coli",), ("Enterobacter coli K12",), ("Bacillus",), ("E coli",)], "name string")
    got = {r.article: r.organisms for r in taxa.full_names(lists, known).collect()}
    assert got == {1: ["Escherichia coli", "Bacillus subtilis", "C roseus"], 2: None, 3: None, 4: None}


def test_enzymes(spark):
    known = spark.createDataFrame([("a", "g", "1"), ("a", "g", "2 "), ("p1", "h", "9"), ("p2", "h", "8"), ("a", "z", "0"), ("p1", "z", "5"), ("p2", "z", None)], "organism string, gene string, ec string")
    popular = spark.createDataFrame([("p2", "k", "4"), ("p1", "k", "0"), ("p9", "k", "3"), ("p2", "m", "7"), ("p1", "m", "6")], "organism string, gene string, ec string")
    wanted = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", "h"), ("a", "z"), ("p1", "k"), ("p1", "m"), ("b", "m"), (None, "g"), ("b", "z")], "organism string, gene string")
    ask = lambda **kw: {(r.organism, r.gene): (r.ecs, r.step) for r in taxa.enzymes(wanted, known, popular, ["p1", "p2"], **kw).collect()}
    got = ask()
    assert got[("a", "g")] == (["1", "2"], "exact") and got[("b", "h")] == (["8", "9"], "across") and got[("a", "z")] == ([], "exact")
    assert got[("p1", "k")] == (["4"], "popular") and got[("p1", "m")] == (["6"], "popular") and got[("b", "m")] == ([], "none") and got[("b", "z")] == (["5"], "across")
    assert ask(across=False)[("b", "h")] == ([], "none") and len(got) == 8
