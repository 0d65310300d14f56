"""A corpus pipeline: quality rules, language ID, near-dedup, mixing and BPE, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, what its predecessor kept.
All but the last return the columns of docs. Null texts, nulls in other columns, very
long texts, repeated rows and empty tables are handled as the operators' docstrings say; a stage
never fails on them. Columns beyond CORE go through the stages under names of their own, so they may
have any name, those of operators' results included, and keep their values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.llm import bpe, langid, mcd, mixing, neardup
from textengine.llm.common import documents, materialize
from textengine.scratch import BATCH


#: Columns that the stages read.
CORE = ("doc_id", "text", "lang", "source")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_any_names(stage: Stage) -> Stage:
    """The stage on a table whose other columns have names that nothing else has."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in CORE else f"__extra{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run_stage


@with_any_names
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what fails the base rules and the robust outliers of its language and source."""
    columns = docs.columns
    return mcd.quality(docs, keep=tuple(columns)).where("kept").select(columns)


@with_any_names
def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts that no learned language explains better than all
    others together. If no row has a language to learn from, nothing is dropped."""
    columns = docs.columns
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model.n_langs:
        return docs
    named = langid.predict(docs, model, keep=tuple(columns))
    model.drop()
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(columns)


@with_any_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each component, once. Rows without id stay. Different
    texts of one id are documents of their own; of rows with equal id and text the one whose hash is least stays."""
    columns, digest = docs.columns, F.xxhash64("text")
    again = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"), F.min(digest).alias("__least")).where("__n > 1")
    again, _ = materialize(again, "repeated-ids")
    named, repeated = docs.withColumn("__doc", F.col("doc_id")), not again.isEmpty()
    if repeated:
        # Beyond all ids, so the texts that keep theirs come first.
        other = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1))
        named = docs.join(again.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left")
        named = named.select(*columns, F.when(digest != F.col("__least"), other).otherwise(F.col("doc_id")).alias("__doc"))
    kept = neardup.near_duplicates(named.select(F.col("__doc").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    rows = named.join(kept.hint("shuffle_hash"), F.col("__doc").eqNullSafe(F.col("__kept")), "left_semi")
    if repeated:
        one = F.row_number().over(W.partitionBy("__doc", F.when(F.col("__doc").isNull(), F.xxhash64(*columns))).orderBy(F.xxhash64(*columns)))
        rows = rows.withColumn("__n", one).where(F.col("__doc").isNull() | (F.col("__n") == 1))
    return rows.select(columns)


@with_any_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop whole documents so that sources come near their targets: a document
    occurs as often as the block of its middle word is in the mix."""
    columns = docs.columns
    mixed = mixing.mix(docs, keep=tuple(columns))
    return mixed.withColumn("__copy", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select(columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document of the mix."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source", "lang"))


STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL can't express the models and the tokenizer; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read back as the next one's docs."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), BATCH)
    return STAGES[-1][1](spark, docs, sf_dir)
