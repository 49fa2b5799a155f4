import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import data
from lodestone.llm import embed_join, html_text, langid, line_dedup, unit_dedup


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_language_id(spark):
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(small).join(small.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n >= 0.98
    odd = langid.identify(data.documents(spark)).collect()
    assert len(odd) == len(data.tricky()) and all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3, 4}
    none = data.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(data.documents(spark, [])).count() == 0
    kept = langid.keep_identified(small)
    assert kept.columns == small.columns and kept.count() >= 0.95 * small.count()


def test_ftrl_leaves_coordinates_at_zero():
    model = langid.Model(["a", "b"], np.ones(langid.DIM), np.zeros((langid.DIM + 1, 2), np.float32))
    texts = ["the house of the", "das haus von der"] * 20
    found = [langid.features(t) for t in texts]
    langid.train_ftrl(model, found, [0, 1] * 20)
    langid.calibrate(model, found[:4], [0, 1, 0, 1])
    assert (model.weight == 0).mean() > 0.9 and [model.predict(t)[0] for t in texts[:2]] == ["a", "b"]


PAGES = [
    (1, None, ""),
    (2, "", ""),
    (3, "<html><body></body></html>", ""),
    (4, "<nav><a>x</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three<p>four</article><footer>f</footer>", "A & B\nOne two three\nfour"),
    (5, "<article><p>main<aside>side</aside> text</p><div class='comments'><p>first!</p></div><form>f</form><script>s</script></article>", "main\ntext"),
    (6, "<div id=menu><ul><li><a href=x>Home</a><li><a>News</a></ul></div><div><p>" + "word " * 40 + "</p><p>" + "more " * 40 + "</p></div><div class=footer>c</div>", ("word " * 40).strip() + "\n" + ("more " * 40).strip()),
    (7, "<article><p>a < b &lt;i&gt; &#8364;<!-- no --></article><p>outside", "a < b <i> €"),
    (8, "<article><p>cut <b>off", "cut off"),
]


def test_html(spark):
    table = spark.createDataFrame([(i, "u", h, "x") for i, h, _ in PAGES], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(table).collect()}
    assert got == {i: (t, len(t)) for i, _, t in PAGES}


@pytest.mark.parametrize("pivots", [None, 4])
def test_embeddings(spark, pivots):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 8))
    x = [(base[rng.integers(30)] + rng.normal(size=8) * rng.choice([0.05, 0.25, 0.4])).tolist() for _ in range(400)]
    table = [(i, v, int(rng.integers(3)) if i % 11 else None) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [None] * 8, 1), (504, x[0], 0), (505, x[0], 0), (506, [float("inf")] + [1.0] * 7, 1)]
    df = spark.createDataFrame([(*r, 7) for r in table], "vec_id long, embedding array<double>, label int, n_links int")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in table if lab is not None and v is not None and not any(a is None or not np.isfinite(a) for a in v) and any(v)}
    label = {i: lab for i, _, lab in table}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and good[a] @ good[b] >= 0.93]
    comp = brute.components({r[0] for r in table}, links)
    want = sorted((i, sum(i in e for e in links), comp[i], comp[i] == i) for i, _, _ in table)
    assert len(links) > 50
    block, embed_join.BLOCK = embed_join.BLOCK, 50
    try:
        assert rows(embed_join.near_vectors(df, pivots=pivots), "vec_id", "n_links", "component_id", "kept") == want
    finally:
        embed_join.BLOCK = block
    assert embed_join.near_vectors(df.limit(0)).count() == 0


def test_unit_dedup(spark):
    for df, docs in data.both(spark):
        seen, want = {}, []
        order = sorted({(d, t or "") for d, t in docs})
        spots = sorted((d, a, t, b) for d, t in order for a, b in unit_dedup.units(t, "line"))
        for d, a, t, b in spots:
            plain = unit_dedup.normalise(t[a:b])
            if plain and plain.count(" ") + 1 >= 2:
                seen.setdefault(plain, (d, a, t))
        for d, t in docs:
            t, kept, n = t or "", [], 0
            for a, b in unit_dedup.units(t, "line"):
                plain = unit_dedup.normalise(t[a:b])
                if plain in seen and seen[plain] != (d, a, t):
                    n += 1
                else:
                    kept.append(t[a:b])
            want.append((d, n, "\n".join(kept)))
        if len({t for d, t in docs if d == 10}) <= 1:
            assert rows(unit_dedup.remove_repeats(df, min_words=2), "doc_id", "n_removed", "text") == sorted(want)


def test_line_dedup(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    long_ = [" ".join(word() for _ in range(200)) for _ in range(6)]
    near = [" ".join(w if i != 100 else "other" for i, w in enumerate(x.split())) for x in long_]
    docs = [(1, "\n".join(long_)), (2, "\n".join(near)), (3, "Same line 12\n\nsame LINE, 99!\n--\n--"), (4, None), (5, ""), (6, "same line 34"), (7, word()), (7, "x y")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(data.documents(spark, docs)).collect()}
    assert out[1].n_removed == 0 and out[1].text == docs[0][1] and out[4].text is None and out[4].n_lines == 0
    assert out[3].removed == [2] and out[3].text == "Same line 12\n\n--\n--" and out[6].text == ""
    assert out[2].n_removed == 6  # one changed word of 200 each
    assert out[2].text == "\n".join(x for i, x in enumerate(near) if i not in out[2].removed)
    df = data.documents(spark)
    kept = line_dedup.keep_first_lines(df)
    assert kept.columns == df.columns
    assert line_dedup.dedup_lines(data.documents(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, data.SF)
    assert "sequence_id" in got.columns and got.count() > 0


def test_packing_holds_targets_over_chunks(spark):
    import public_tokenizers

    from lodestone.llm import packing

    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randrange(20, 200)))) for i in range(1500)]
    df = data.documents(spark, docs).withColumn("source", F.when(F.col("doc_id") % 5 < 2, "a").when(F.col("doc_id") % 5 < 4, "b").otherwise(F.lit(None)))
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), window=512, chunk_tokens=20_000, targets={"a": 3, "b": 1}).collect()
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, {}).setdefault(r.source, 0)
        windows[r.sequence_id][r.source] += r.length
    order = sorted(windows)
    all_a = sum(w.get("a", 0) for w in windows.values())
    done, on_target, seen = 0, 0, 0
    for k in order:
        w = windows[k]
        if done < 0.9 * all_a and sum(w.values()) == 512:
            seen += 1
            on_target += abs(w.get("a", 0) / 512 - 0.75) <= 0.1 and None not in w
        done += w.get("a", 0)
    assert len({k >> 32 for k in order}) >= 6 and seen > 50 and on_target >= 0.95 * seen
    assert sum(None in windows[k] for k in order[: len(order) // 2]) == 0
