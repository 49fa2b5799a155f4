import data
from lodestone.llm import decontam, embed_join, langid, line_dedup, minhash, packing, suffix_dedup, unit_dedup
from pyspark.sql import functions as F

LONG = data.tricky()[7][1]


def table(spark):
    return data.documents(spark, [(8, LONG), (9, LONG + " tail")]).unionByName(data.documents(spark, [(0, LONG), (0, "only here"), (0, None)]).withColumn("doc_id", F.lit(None).cast("long")))


def test_rows_without_an_id_come_through(spark):
    docs = table(spark)
    for got in (line_dedup.dedup_lines(docs), langid.identify(docs), unit_dedup.remove_repeats(docs), suffix_dedup.repeated_bytes(docs)):
        assert sum(r.doc_id is None for r in got.collect()) == 3


def test_near_duplicates_keep_rows_without_an_id(spark):
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(table(spark)).collect())
    assert got == [("8", "8", True), ("9", "8", False)] + [("None", "None", True)] * 3
    assert minhash.drop_near_duplicates(table(spark)).count() == 4


def test_items_without_an_id_hit_but_are_not_listed(spark):
    items = spark.createDataFrame([(None, LONG[:300]), (3, None)], "item_id long, text string")
    got = {(r.doc_id, r.n_items, r.contaminated, r.n_hit > 0) for r in decontam.contamination(table(spark), items).collect()}
    assert got == {(8, 0, True, True), (9, 0, True, True), (None, 0, True, True), (None, 0, False, False)}
    assert decontam.remove_contaminated(table(spark), items).count() == 2


def test_packing_keeps_null_ids(spark):
    import public_tokenizers

    got = packing.pack(table(spark), public_tokenizers.path("byte_bpe_50k.json")).collect()
    ends = [r for r in got if r.start + r.length == r.doc_tokens]
    assert len(ends) == 5 and sum(r.doc_id is None for r in ends) == 3


def test_vectors_without_an_id_link_with_nothing(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r.vec_id), r.n_links) for r in embed_join.near_vectors(emb).collect()) == [("1", 1), ("2", 1), ("None", 0)]


def test_token_store_puts_rows_without_an_id_first(spark, tmp_path):
    import public_tokenizers
    from lodestone.llm import arrow_store

    path = public_tokenizers.path("word_bpe_49k.json")
    shards = arrow_store.write_store(table(spark), f"file://{tmp_path}/s", path, shard_docs=2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in arrow_store.read_store(spark, shards).collect())
    assert [r[1] for r in got] == [None, None, None, 8, 9] and [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(5)]


def test_repeats_go_from_rows_without_an_id_too(spark):
    only = "z" * 10 + "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(300))
    for other in (None, 1):
        docs = data.documents(spark, [(5, only + " five")]).unionByName(data.documents(spark, [(0, "none " + only)]).withColumn("doc_id", F.lit(other).cast("long")))
        assert all(r.n_removed >= len(only) for r in suffix_dedup.repeated_bytes(docs).collect())
    lines = data.documents(spark, [(5, "one line here\nmine")]).unionByName(data.documents(spark, [(0, "one line here\nyours")]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((str(r.doc_id), r.n_removed) for r in unit_dedup.remove_repeats(lines).collect()) == [("5", 0), ("None", 1)]
    assert sorted((str(r.doc_id), r.n_removed) for r in line_dedup.dedup_lines(lines).collect()) == [("5", 0), ("None", 1)]
