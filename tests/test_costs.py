"""Costs that must not grow with what a query is built from, and rules that quick scans stand before."""

import random
import re
import time
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions import cleaning, phrases, rawtext, terms
from lodestone.operators import sentences
from lodestone.plans import extra


def test_raw_text_is_made_once(spark):
    """brackets and sentence ends made the rules before them run again at each mention."""
    df = spark.createDataFrame([("a (b c) d. E",)], "t string")
    seen = lambda c: df.select(c.alias("o"))._jdf.queryExecution().analyzed().toString().count("MARK")
    assert seen(rawtext.hyphenated_bracket(F.regexp_replace("t", "MARK", ""))) == 1
    assert seen(terms.sentences_of(F.regexp_replace("t", "MARK", ""))) == 1


def test_citations_by_quick_scans(spark):
    """what a scan passes over holds no citation, whatever the marks, and long texts without one are quick."""
    rng = random.Random(5)
    bits = ["J", "Biol.", "Chem", "12", "(3)", "4:", "5–", "7", "99.", "doi:", "DOI", "10.1/2", "Received:", ":", "12 May 2001", "May 3, 2010", "www.x.org/a", "Expression", ".com/", "é", "\n", "(", ")", ",", ";"]
    values = ["".join(b + rng.choice(["", " ", " ", "  "]) for b in rng.choices(bits, k=rng.randint(1, 14))) for _ in range(3000)]

    def plain(t):
        found = [m[1] for m in re.finditer(cleaning.JOURNAL, t)]
        t = reduce(lambda x, w: x.replace(w, ""), (w for w in found if not re.match(cleaning.NOT_JOURNAL, w)), t)
        return reduce(lambda x, p: re.sub(p, "", x), cleaning.CITATIONS, t)

    assert sum(plain(v) != v for v in values) > 300
    assert list(cleaning.without_citations.func(pd.Series(values))) == [plain(v) for v in values]
    began = time.time()
    cleaning.without_citations.func(pd.Series(["some words of a text without any " * 20000]))
    assert time.time() - began < 1


def test_a_sentence_of_several_texts_is_cut_once(spark):
    """each source cut its texts anew, and its query read the articles once for each."""
    rows = [(1, ["adhE", "gapA"], "Deletion of adhE, and gapA was grown. Expression of gapA rose.", "Expression of gapA rose."), (2, ["x1"], None, "x1 was deleted."), (3, [], "adhE", "adhE")]
    df = spark.createDataFrame(rows, "article long, genes array<string>, a string, b string")
    both = sentences.source_clauses(df, {"a": F.col("a"), "b": F.col("b")}, ["the", "and"])
    got = {(r.article, r.source, r.clause, tuple(r.named), tuple(r.place)) for r in both.collect()}
    alone = {(r.article, c, r.clause, tuple(r.named), tuple(r.place)) for c in ("a", "b") for r in sentences.clauses(df, ["the", "and"], c).collect()}
    assert got == alone and len(got) > 4
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_short_sentences_are_changed_once():
    """Sentences that recur met all rules each time; long ones aren't kept."""
    met = []
    change = phrases.remembered(lambda s: met.append(s) or s.upper())
    long_ = "x" * (phrases.KEPT_LENGTH + 1)
    assert [change(s) for s in ("a.", "b.", "a.", long_, long_)] == ["A.", "B.", "A.", long_.upper(), long_.upper()]
    assert met == ["a.", "b.", long_, long_]


def test_pieces_are_cut_once_a_distinct_text(spark):
    """every part had its own pieces, some 40 rows each, which a distinct then held."""
    plan = extra.QUERIES["JN14"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert "Aggregate" in plan[at + 1] and "p_partkey" not in plan[at + 1]
