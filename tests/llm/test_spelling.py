import re
import zlib
from collections import Counter

import numpy as np
import pytest

import data
from lodestone.llm import spelling


def words(docs, least=7, least_n=2):
    count = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= least_n}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(vocab):
    by = {}
    for w in vocab:
        by.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w, n in vocab.items():
        others = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by.get(size, []) if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * n else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, n_near[w], vocab[form[w]] if form[w] else None) for w, n in vocab.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


HARD = [
    (1, "letters Letters LETTERS lettters letter-s leters lettres"), (2, "letters " * 300 + "lettersx " * 25 + "lettersxy xlettersxy xlettersxy lettersxy"), (3, None), (4, ""), (5, "123 ++ \n"), (5, "aaaaaaa aaaaaaaa aaaaaaaaa AAAAAAA"),
    (6, "aaaaaaa aaaaaaaa aaaaaaaaa baaaaaaa aaaaaaab aaabaaa aaabaaa"), (7, "Éléphants éléphants Éléphants éléphants ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ ×÷×÷×÷× ×÷×÷×÷×"), (8, "x" * 40000 + " " + "x" * 40001 + " " + "x" * 40000 + " " + "x" * 40001), (None, "letters letterss letterss"),
    (1, "letters Letters LETTERS lettters letter-s leters lettres"), (9, "ŉletters lettersĀletters"),
]


@pytest.mark.parametrize("rows", [HARD, data.tricky(), [], [(i, f"wordnumber wordnumbe{chr(97 + i % 26)} wordnumer ") for i in range(400)]])
def test_against_plain(spark, rows):
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n long")
    assert got(spelling.spelling_groups(df)) == plain(words(rows))


def test_driver_tables(spark):
    df = spark.read.parquet(f"{data.SF}/documents.parquet")
    assert got(spelling.spelling_groups(df)) == plain(words([tuple(r) for r in df.select("doc_id", "text").collect()]))


def test_neighbours_are_all_and_distinct():
    alphabet = [ord(c) for c in "abé"]
    for given in (["abba", "a", "éé", "bab"], ["aaaa"]):
        every = [[w[:i] + w[i + 1 :] for i in range(len(w))] + [w[:i] + chr(c) + w[i + 1 :] for i in range(len(w)) for c in alphabet] + [w[:i] + chr(c) + w[i:] for i in range(len(w) + 1) for c in alphabet] for w in given]
        want = [set(x) - {w} for w, x in zip(given, every)]
        out = [[] for _ in given]
        for word, h1, h2 in spelling.neighbours(given, np.array(alphabet, np.uint64), lambda h: np.ones(h.shape, bool)):
            for w, x in zip(word, zip(h1.tolist(), h2.tolist())):
                out[w].append(x)
        for w, x in zip(want, out):
            letters, ends = spelling._letters(sorted(w))
            h = set(zip(*(spelling._Hasher(letters, ends, i).words().tolist() for i in (0, 1))))
            assert set(x) == h and len(x) == len(w)
