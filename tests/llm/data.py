"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SF = "/root/testdata/sf0.001"


def tricky(seed=0):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "Éta", "übung", "x1", "don't", "zeta", "omega", "kappa", "pi"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, other = say(200), say(120)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "..."), (5, "one"), (6, "One"), (7, "one two"), (8, base), (9, base), (10, base + " tail"), (10, base + " tail"), (11, other + "\n" + base), (12, other)]
    rows += [(20 + i, " ".join(w if rnd.random() > 0.004 * i else "changed" for w in base.split())) for i in range(12)]
    rows += [(50, "the same line\nthe same line\nThe  same line!\nanother line here"), (51, "the same line\nand more\n\n\n"), (52, "é" * 700), (53, "é" * 450 + "x"), (54, "a" * 3000), (60, say(20000)), (61, say(20000))]
    return rows


def documents(spark, rows=None):
    rows = tricky() if rows is None else rows
    more = [(d, t, ["en", "de", None][d % 3], ["s0", "s0", "s1", None][d % 4], 1, 2, "z", 5, [1], True) for d, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, n_words long, sig string, rep long, spans array<int>, kept boolean")


def both(spark):
    """(data frame, its rows) for the tricky rows and a small table of the driver's."""
    small = spark.read.parquet(f"{SF}/documents.parquet")
    yield documents(spark), tricky()
    yield small, [tuple(r) for r in small.select("doc_id", "text").collect()]
    yield documents(spark, []), []
