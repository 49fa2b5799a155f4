import numpy as np
import public_tokenizers as P
import pytest

import brute
import data
from lodestone.llm import arrow_store, decontam, minhash, packing, suffix_dedup
from lodestone.llm import common as C


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    for df, docs in data.both(spark):
        got = rows(minhash.near_duplicates(df, k=k), "doc_id", "n_shingles", "component_id", "kept")
        assert got == brute.near(docs, k)


def test_decontamination(spark):
    for df, docs in data.both(spark):
        items = [(1, "alpha Beta"), (2, None), (3, ""), (4, "--"), (7, "alpha beta"), (8, "pi"), (10, "gamma")] + [(20 + i, " ".join((docs[i % len(docs)][1] or "").split()[:14])) for i in range(6) if docs]
        items += [tuple(r) for r in spark.read.parquet(f"{data.SF}/benchmark.parquet").collect()]
        table = spark.createDataFrame(items, "item_id long, text string")
        want = brute.contaminated(docs, items)
        cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert rows(decontam.contamination(df, table), *cols) == want
        clean = decontam.remove_contaminated(df, table)
        assert clean.columns == df.columns
        assert rows(clean, "doc_id") == sorted((w[0],) for w in want if not w[5])
    # several blocks of items, and none
    blocks = decontam.annotate(data.documents(spark), table, block_bytes=300)
    whole = decontam.annotate(data.documents(spark), table)
    assert rows(blocks, "doc_id", "__n_words", "__spans", "__items", "__longest") == rows(whole, "doc_id", "__n_words", "__spans", "__items", "__longest")
    assert decontam.contamination(data.documents(spark), table.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("length,gram,shard", [(400, 24, 3_000_000), (40, 8, 3_000_000), (40, 8, 2000)])
def test_repeated_bytes(spark, length, gram, shard):
    for df, docs in data.both(spark):
        docs = [d for d in docs if length == 400 or len(d[1] or "") < 5000]
        if length < 400:
            df = df.where("text is null or length(text) < 5000")
        got = rows(suffix_dedup.repeated_bytes(df, length, gram, shard), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.repeats(docs, length)


def test_token_store(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    from lodestone.llm import tokens

    whole = tokens.encoder(path).whole
    for n, (df, docs) in enumerate(data.both(spark)):
        folder = f"file://{tmp_path}/{n}"
        shards = arrow_store.write_store(df, folder, path, length=64, rows=4)
        got = arrow_store.read_store(spark, shards).orderBy("start").collect()
        at, want = 0, []
        for d, t in sorted(docs, key=lambda r: (r[0], r[1] or "")):
            ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
            want.append((d, at, len(ids), brute.crc(ids)))
            at += len(ids)
        assert [tuple(r) for r in got] == want
        if shards:
            shard = arrow_store.Shard(shards[0][0])
            flat = np.concatenate([shard.sequence(i)[shard.mask(i)] for i in range(len(shard))])
            assert len(flat) == shards[0][2] and shard.sequence(0).base is not None
            assert (flat == shard.ids(0, len(flat))).all()


def test_packing(spark):
    path = P.path("byte_bpe_50k.json")
    from lodestone.llm import tokens

    whole = tokens.encoder(path).whole
    for df, docs in data.both(spark):
        if len({d for d, _ in docs}) < len(docs):
            df = df.dropDuplicates(["doc_id"])
        docs = dict(docs)
        got = packing.pack(df, path, window=256, chunk_tokens=20_000).collect()
        ids = {d: whole.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs.items()}
        by_doc, by_seq = {}, {}
        for r in got:
            assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
            by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert set(by_doc) == set(docs)
        for d, pieces in by_doc.items():
            assert gapless(pieces) == len(ids[d])
        full = [gapless(p) for p in by_seq.values()]
        assert all(n <= 256 for n in full)
        if full:
            chunks = -(-sum(full) // 20_000)
            assert sum(n < 256 for n in full) <= chunks


def gapless(pieces):
    at = 0
    for s, n in sorted(pieces):
        assert s == at and n > 0
        at += n
    return at


def test_windows_follow_the_mixture():
    take = packing.fill_windows(np.array([0.5, 0.3, 0.2]), np.zeros(3), np.array([5000, 3000, 2000]), 100)
    assert (take.sum(1) == 100).all() and (take.sum(0) == [5000, 3000, 2000]).all()
    assert (np.abs(np.cumsum(take, 0) - np.arange(1, 101)[:, None] * [50, 30, 20]) <= 1).all()
    # what a source was owed before is made up for at once, and a dry queue's part goes to the others
    take = packing.fill_windows(np.array([0.5, 0.5]), np.array([20.0, -20.0]), np.array([100, 500]), 100)
    assert take[0].tolist() == [70, 30] and take.sum() == 600


def test_components(spark):
    rnd = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(50)]
    got = {r.id: r.component for r in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got or v == k for k, v in want.items())
