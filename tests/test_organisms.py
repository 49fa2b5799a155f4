import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import organisms

TAXONOMY = [("Escherichia", "Escherichia coli K-12"), ("Escherichia", "Escherichia coli"), ("Synechocystis", "Synechocystis <i>aquatilis</i> 6803x"), ("Bacillus/Geobacillus", "Bacillus subtilis 168"), ("Bacillus/Geobacillus", "Geobacillus oil-degrading x1"), ("9lives", "9lives felis")]


def plain(tokens):
    """The rule order over one row, token by token."""
    genera = {g.capitalize() for x, _ in TAXONOMY for g in x.split("/")}
    initials = {g[0].upper() for x, _ in TAXONOMY for g in x.split("/")}
    full = set()
    for _, n in TAXONOMY:
        two = re.sub("[^a-zA-Z0-9 ]+", " ", re.sub("<.*?>", "", " ".join(n.split(" ")[:2]))).rstrip().lower()
        if not two[0].isdigit():
            full.add(" ".join(two.split()[:2]))
    short = {f"{p[0]} {p.split()[1]}" for p in full}
    codes = {n.split(" ")[1].lower() for _, n in TAXONOMY if "degrading" not in n.split(" ")[1].lower()} | {n.split(" ")[-1].lower() for _, n in TAXONOMY}
    tokens = [t or "" for t in tokens or []]
    at = lambda i: tokens[i] if i < len(tokens) else ""
    places = [i for i in range(len(tokens) - 1) if at(i) and at(i + 1)]
    any_full = any(at(i).capitalize() in genera for i in places)
    sure, brief = [], []
    for i in places:
        a, b, c, d = (at(i + k) for k in range(4))
        if a.capitalize() not in (genera if any_full else genera | initials) or a[0].isdigit() or len(a) == len(b) == 1:
            continue
        pair, general = f"{a} {b}".lower(), b.lower() in ("pcc", "spp", "sp")
        coded = lambda t: bool(t) and (re.fullmatch("[A-Z0-9]+", t) is not None or t.lower() in codes)
        if pair in full or general:
            name = f"{a} {b}"
            if general and c and (coded(c) or c.lower() in ("pcc", "atcc")):
                name += f" {c}"
                if c.lower() in ("pcc", "atcc") and coded(d):
                    name += f" {d}"
            sure.append(name)
        elif pair in short:
            brief.append(f"{a} {b}")
    found = list(dict.fromkeys(sure or brief))
    return found or (["yeast"] if any(t.lower() == "yeast" for t in tokens) else None)


CASES = {
    "the Escherichia coli strain": ["Escherichia coli"],
    "Synechocystis sp PCC 6803": ["Synechocystis sp PCC 6803"],
    "E coli": ["E coli"],
    "engineered Yeast": ["yeast"],
    "H 2": None,
    "E coli and Bacillus subtilis": ["Bacillus subtilis"],  # an initial counts only without a full genus
    "Bacillus sp x1 and bacillus sp grown": ["Bacillus sp x1", "bacillus sp"],
    "bacillus spp ATCC 7b": ["bacillus spp ATCC"],
    "9lives felis": None,
    "B sp": ["B sp"],
    "Bacillus Escherichia coli yeast": ["Escherichia coli"],
    "Geobacillus oil degrading": ["Geobacillus oil"],
}


def test_rule_order_and_random_rows(spark):
    rnd = random.Random(1)
    words = ["Escherichia", "escherichia", "coli", "E", "e", "B", "subtilis", "sp", "SPP", "pcc", "ATCC", "6803", "X1", "x1", "K-12", "168", "Synechocystis", "aquatilis", "9lives", "felis", "yeast", "the", "Geobacillus", "oil", "", None]
    rows = [(i, k.split(" ")) for i, k in enumerate(CASES)] + [(1000 + i, [rnd.choice(words) for _ in range(rnd.randint(0, 9))]) for i in range(600)] + [(5000, None)]
    df = spark.createDataFrame(rows, "article int, tokens array<string>").withColumn("pos", F.lit(1)).withColumn("name", F.lit("clash"))
    names = organisms.dictionary(spark.createDataFrame(TAXONOMY + [(None, None)], "genus string, full_name string"))
    got = {r.article: r.organisms for r in organisms.detect(df.repartition(4), names).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert got == {i: plain(t) for i, t in rows}
    assert organisms.detect(df.limit(0), names).count() == 0


def test_cascade_nulls_yeast(spark):
    rows = [(1, ["yeast"], ["E", "coli"]), (2, ["yeast"], ["x"]), (3, ["Bacillus", "subtilis"], ["E", "coli"])]
    df = spark.createDataFrame(rows, "article int, title array<string>, abstract array<string>")
    names = organisms.dictionary(spark.createDataFrame(TAXONOMY, "genus string, full_name string"))
    out = organisms.cascade(df, ["title", "abstract"], lambda d, c: organisms.detect(d, names, c), "organisms", F.array(F.lit("yeast")))
    assert sorted((r.article, r.organisms, r.organisms_source) for r in out.collect()) == [(1, ["E coli"], "abstract"), (2, None, "not_found"), (3, ["Bacillus subtilis"], "title")]


def test_articles_and_names_are_made_once(spark):
    """articles were made from their lines for each mention, and a dictionary was as large as its taxonomy to Spark."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for name in ("Q3", "STR41"):
        assert "l_orderkey" not in plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    names = organisms.dictionary(spark.createDataFrame([("Aba", "Aba cdo x"), ("Efe", "Efe gho")], "genus string, full_name string"))
    assert all("Aggregate" not in plan(t) for t in (names.genera, names.pairs, names.codes))
    told = organisms.detect(spark.createDataFrame([(1, ["A", "cdo", "in", "Efe", "gho", "cells"]), (2, ["A", "cdo"])], "article int, tokens array<string>"), names)
    assert {r.article: r.organisms for r in told.collect()} == {1: ["Efe gho"], 2: ["A cdo"]}
    assert "Window" not in plan(told)
