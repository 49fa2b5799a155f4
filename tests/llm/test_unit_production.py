"""op8 as registered, against a plain version, on the hard rows and with planted passages."""

import random
import re

import data
import __spark_entry__ as entry
from lodestone.llm import queries, unit_dedup


def plain(docs, least):
    """Sentences one by one; normalised by lower case, single blanks and bare ends (the texts hold no compatibility forms)."""
    cut = re.compile(r"\n|(?<=[.!?])[^\S\n]+|(?<=[。！？])")
    norm = lambda u: re.sub(r"^[\W_]+|[\W_]+$", "", " ".join(u.casefold().split()))
    count = lambda w: max(w.count(" ") + 1, len(w) // 6)
    order = sorted({(d if d is not None else 1 << 63, t or "") for d, t in docs})
    first, places = {}, {}
    for d, t in order:
        at = 0
        places[d, t] = []
        for m in [*cut.finditer(t), None]:
            end = m.start() if m else len(t)
            places[d, t].append((at, end, norm(t[at:end])))
            at = m.end() if m else at
    for d, t in order:
        for a, _, w in places[d, t]:
            if w:
                first[w] = min(first.get(w, (d, a)), (d, a))
    out = []
    for d, t in docs:
        d2, t = (d if d is not None else 1 << 63), t or ""
        gone, run, words = [], [], 0
        for a, b, w in [*places[d2, t], (0, 0, None)]:
            if w and first[w] != (d2, a):
                run.append([a, b])
                words += count(w)
            elif w or w is None:
                gone += run if words >= least else []
                run, words = [], 0
        out.append((d, len(places[d2, t]) if t else 0, len(gone), gone))
    return sorted(out, key=repr)


def planted(n=60):
    rnd = random.Random(2)
    say = lambda k: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(k))
    shared = [f"{say(9)}. {say(20)}! {say(7)}?\n{say(30)}." for _ in range(3)]
    rows = []
    for i in range(n):
        text = f"Heading\n{say(40)}. The end."
        if i % 6 == 5:
            text = f"Heading\n{say(12)}. {shared[i // 6 % 3]}\n{say(15)}. The end."
        rows.append((i, text))
    return rows


def test_registered_query(spark, tmp_path):
    rows = planted() + [(d + 1000, t) for d, t in data.tricky()] + [(None, "A lone text. " * 30), (None, "A lone text. " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op8_unit_dedup"](spark, str(tmp_path)).collect()
    want = plain(rows, queries.PASSAGE_WORDS)
    assert sorted(((r.doc_id, r.n_units, r.n_removed, [list(s) for s in r.spans]) for r in got), key=repr) == want
    by = {r.doc_id: r for r in got}
    # later copies of a planted passage go whole; headings and closing words stay, as do documents without one
    later = [i for i in range(60) if i % 6 == 5][3:]
    assert all(by[i].n_removed == 4 and "Heading" in by[i].text and "The end." in by[i].text for i in later)
    assert all(by[i].n_removed == 0 for i in range(60) if i not in later)


def test_short_lines_go_by_default(spark):
    docs = data.documents(spark, [(1, "All rights reserved\n--\nfirst"), (2, "all rights reserved.\n--\n\nsecond"), (3, "这是一个很长的没有空格的句子"), (4, "这是一个很长的没有空格的句子\nthird"), (5, "First")])
    got = {r.doc_id: (r.n_removed, r.text) for r in unit_dedup.remove_repeats(docs).collect()}
    assert got == {1: (0, "All rights reserved\n--\nfirst"), 2: (1, "--\n\nsecond"), 3: (0, "这是一个很长的没有空格的句子"), 4: (1, "third"), 5: (1, "")}
