"""The registered queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_middle, langid, lm_score, mcd, mixing, neardup, prefix_bpe, sharding, token_counts, token_files, whitening, winnow
from .common import documents, shared_dir

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic; background: all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id", F.lit(True).alias("target"))
    return lm_score.score_all(docs, marks=good)


def op2_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op4_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), shards=40)
    return sharded.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_files(documents(spark, sf_dir), target, public_tokenizers.path(TOKENIZER))
    return token_files.read_files(spark, target).withColumnRenamed("key", "doc_id")


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held))
    found = langid.predict(docs, model)
    model.drop()
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    third = F.expr("char_length(text) div 3").cast("int")
    near = winnow.with_next(docs, "doc_id", {"text": F.col("text"), "chosen": winnow.fingerprint(F.col("text"))})
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    near = near.withColumn("edited", edited)
    return near.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "chosen",
        "next_chosen",
        winnow.fingerprint(F.col("edited")).alias("edited_chosen"),
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        winnow.as_text(F.col("chosen")).alias("fingerprint"),
        winnow.as_text(F.col("edited_chosen")).alias("edited_fingerprint"),
        winnow.likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
        winnow.likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(documents(spark, sf_dir))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_cross_entropy_difference,
        op2_bpe_pair_index,
        op3_mcd_quality,
        op4_multi_index_dedup,
        op5_hypergeometric_shards,
        op6_token_files,
        op7_sainte_lague_mix,
        op8_language_id,
        op9_winnowing,
        op10_token_counts,
        op11_prefix_bpe,
        op12_fill_in_middle,
        op13_block_whitening,
    )
}

#: None of these can be said in DuckDB's SQL over whole tables; tests/llm holds brute-force versions.
ORACLE_SQL: dict[str, str] = {}
