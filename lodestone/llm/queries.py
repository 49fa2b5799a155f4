"""The corpus operators as queries over the tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.dedup_lines(C.table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(C.table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.main_text(C.table(spark, sf_dir, "pages"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(C.table(spark, sf_dir, "documents"), k=4)


def op6_embed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed_join

    return embed_join.near_vectors(C.table(spark, sf_dir, "embeddings"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(C.table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")).drop("ids", "source")


#: Every sentence is hashed and counted; those that go stand in passages, runs of later occurrences of this many words.
PASSAGE_WORDS = 20


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import unit_dedup

    return unit_dedup.remove_repeats(C.table(spark, sf_dir, "documents"), kind="sentence", min_run=PASSAGE_WORDS)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.repeated_bytes(C.table(spark, sf_dir, "documents")).drop("spans")


def op10_arrow_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import arrow_store

    folder = C.scratch_path(spark, "token-store")
    shards = arrow_store.write_store(C.table(spark, sf_dir, "documents"), folder, _tokenizer("word_bpe_49k.json"))
    return arrow_store.read_store(spark, shards)


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import personal

    return personal.personal_report(C.table(spark, sf_dir, "documents"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ball_kmeans

    return ball_kmeans.ball_kmeans(C.table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.spelling_groups(C.table(spark, sf_dir, "documents"))


def _oracle() -> dict[str, str]:
    from . import ball_kmeans

    return {"op12_ball_kmeans": ball_kmeans.oracle_sql()}


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_langid, op3_decontaminate, op4_html, op5_minhash, op6_embed_join, op7_pack, op8_unit_dedup, op9_suffix_dedup, op10_arrow_store, op11_personal, op12_ball_kmeans, op13_spelling)
}
ORACLE: dict[str, str] = _oracle()
