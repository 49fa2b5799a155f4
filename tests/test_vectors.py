"""Weights of words and curation by hand cases."""

import math
import re
from collections import Counter

from lodestone.operators import curation, vectors


def test_weights(spark):
    texts = ["A cat and a dog", "the the cat été", "the dog_1 the", None, "", "x"]
    got = {(r.doc_id, r.kind, r.term): r.weight for r in vectors.weights(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, x int"), max_df=0.2).collect()}
    bags = [Counter(re.findall(r"\w\w+", (t or "").lower())) for t in texts]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log(7 / (1 + n)) + 1 for w, n in df.items()}
    want = {}
    for i, b in enumerate(bags):
        for kind, keep, power in (("counts", 0.2, 0), ("tfidf", 0.2, 1), ("tfidf_all", 1, 1), ("tfidf_twice", 1, 2)):
            v = {w: x * idf[w] ** power for w, x in b.items() if df[w] <= keep * 6}
            length = math.sqrt(sum(x * x for x in v.values())) if power else 1
            want |= {(i, kind, w): x / length for w, x in v.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_curated(spark):
    a = spark.createDataFrame([(1, "10.1/A+", "t1", "x"), (1, "10.1/A+", "t1", "x"), (2, " 10.2/b", "t2", "y"), (3, None, "t3", "z"), (None, "10.9", "t", "q")], "pm_id int, doi string, title string, abstract string")
    e = spark.createDataFrame([(1, '"10.1/a and more"', '"T1"'), (2, '"10.2/c"', '"T2"'), (3, '"10.3"', '"T3"')], "pm_id int, doi string, title string")
    c = spark.createDataFrame([("10.2/c", "new"), ("10.7", "lost"), (None, "n")], "doi string, abstract string")
    got = {(r.pm_id, r.doi, r.title, r.abstract, r.origin) for r in curation.curated(a, e, c).collect()}
    assert got == {(1, "10.1/A+", "t1", "x", "fetched"), (3, None, "t3", "z", "fetched"), (None, "10.9", "t", "q", "fetched"), (None, "10.2/c", "T2", "new", "curated"), (None, "10.7", None, "lost", "curated")}
    assert curation.curated(a.limit(0), e.limit(0), c.limit(0)).count() == 0


def test_words_are_counted_in_their_row(spark):
    """Words of a text are told by its row: what shuffles is once a distinct word to its frequency and once back."""
    from lodestone.operators import vectors

    df = spark.createDataFrame([(1, "a bb cc bb Bb"), (2, ""), (3, None), (4, "cc é éé zz zz")], "doc_id long, text string")
    rows = vectors.by_text(df)
    assert sum("Exchange hashpartitioning" in x and "Reused" not in x for x in rows._jdf.queryExecution().executedPlan().toString().split("\n")) <= 4
    got = {r.doc_id: sorted((e.term, e.counts) for e in r.terms) for r in rows.collect()}
    assert got == {1: [("bb", 3.0), ("cc", 1.0)], 4: [("cc", 1.0), ("zz", 2.0), ("éé", 1.0)]}
    told = {(r.doc_id, r.kind): r for r in vectors.sums(df).collect()}
    for r in vectors.weights(df).groupBy("doc_id", "kind").agg({"weight": "sum", "term": "min", "*": "count"}).collect():
        t = told[r.doc_id, r.kind]
        assert abs(t.total - r["sum(weight)"]) < 1e-9 and t.first == r["min(term)"] and t.n_terms == r["count(1)"]
    assert len(told) == 8
