"""Operator 8: language identification by multinomial naive Bayes.

Character n-grams of the letters-only text (orders 1 to 4, lower case, words bounded by a
blank) are hashed into `buckets`; labelled rows give the counts per language, summed by Spark
into a table. The matrix of log probabilities is broadcast in blocks of LANGS languages at most,
so its size is bounded however many values `lang` has. Batches are scored in numpy: every n-gram of a batch looks
its column up, and sums per document give the language with the best posterior. With more than one
block the rows go from one to the next by a written table and carry the best language so far.

The score is the posterior of the predicted language for one average n-gram in `evidence`
n-grams at most, so it stays below 1 and falls where languages are close. A text that is null
or has no letter is `und` with score 0. With no labelled rows every text is `und`. Repeated rows
count as often as they occur. Columns of `keep` named like the operator's own are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import added, columns, drop_table, map_texts, materialize, sliced

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Bytes of text whose n-grams are looked up at a time: their arrays take about 100 times as much.
SLICE = 1 << 20
#: Languages of a block of the matrix: 17 MB of 65,536 buckets.
LANGS = 64
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words of letters, each between blanks; empty without a letter."""
    if not text:
        return ""
    found = _NO_LETTERS.sub(" ", text.lower()).strip()
    if not found or not any(map(str.isalpha, found[:64])) and not any(map(str.isalpha, found)):
        return ""
    return f" {found} "


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, order by order, and the index of each one's text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    code = np.zeros(len(points), np.uint64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    ids, owners = [], []
    for n in range(1, max(ORDERS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = of[:m] == of[n - 1 :]
            mixed = code * np.uint64(0x9E3779B97F4A7C15)
            ids.append(((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> shift).astype(np.int32)[inside])
            owners.append(of[:m][inside])
    empty = np.zeros(0, np.int32)
    return (np.concatenate(ids), np.concatenate(owners)) if ids else (empty, empty)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that is never learned from; a null id is neither learned nor held out."""
    return F.crc32(doc_id.cast("string")) % folds == 0


class Model:
    """Counts of n-grams per language, as a table (k, bucket, n), k being the language's place in order;
    bucket `buckets` holds its texts. drop() deletes the table."""

    def __init__(self, counts: DataFrame, path: str, n_langs: int, n_texts: int, buckets: int):
        self.counts, self.path, self.n_langs, self.n_texts, self.buckets = counts, path, n_langs, n_texts, buckets

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """Languages in order, LANGS at a time, and their log probabilities (float32, languages x
        buckets, then the log prior); the driver holds one block."""
        for low in range(0, self.n_langs, LANGS):
            mine = self.counts.where((F.col("k") >= low) & (F.col("k") < low + LANGS))
            names = [r["lang"] for r in mine.where("lang IS NOT NULL").select("k", "lang").orderBy("k").collect()]
            found = mine.select("k", "bucket", "n").toPandas()  # at most LANGS x buckets rows
            counts = np.zeros((len(names), self.buckets + 1))
            counts[found["k"] - low, found["bucket"]] = found["n"]
            grams_of, docs_of = counts[:, : self.buckets] + 0.5, counts[:, self.buckets :]
            logs = np.log(grams_of) - np.log(grams_of.sum(1, keepdims=True))
            prior = np.log(docs_of + 1) - np.log(self.n_texts + self.n_langs)
            yield names, np.concatenate((logs, prior), axis=1).astype(np.float32)

    def drop(self) -> None:
        drop_table(self.counts.sparkSession, self.path)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """The model of all rows that have a text and a language."""
    lang_of, text_of = columns(lang, text)
    rows = df.where(lang_of.isNotNull() & text_of.isNotNull()).select(lang_of.cast("string").alias("lang"), text_of.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for x, got in sums.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at])], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for part in sliced([batch], "text", SLICE):
                langs = np.array(part.column("lang").to_pylist(), object)
                texts = [letters(t) for t in part.column("text").to_pylist()]
                ids, owner = grams(texts, buckets)
                for x in set(langs):
                    if x not in sums and len(sums) >= LANGS:
                        yield from flush()
                    mine = langs == x
                    got = sums.setdefault(x, np.zeros(buckets + 1, np.int64))
                    got[:buckets] += np.bincount(ids[mine[owner]], minlength=buckets)
                    got[buckets] += sum(1 for t, m in zip(texts, mine) if m and t)
        yield from flush()

    found, first = materialize(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    # One row per language in the window; its name stays with its first bucket alone.
    numbers = found.groupBy("lang").agg(F.min("bucket").alias("least")).withColumn("k", (F.row_number().over(W.orderBy("lang")) - 1).cast("int"))
    named = found.join(numbers, "lang").select("k", "bucket", "n", F.when(F.col("bucket") == F.col("least"), F.col("lang")).alias("lang"))
    counts, path = materialize(named, "language-model")
    drop_table(df.sparkSession, first)
    n_langs, n_texts = counts.agg(F.count("lang"), F.coalesce(F.sum(F.when(F.col("bucket") == buckets, F.col("n"))), F.lit(0))).first()
    return Model(counts, path, n_langs, n_texts, buckets)


#: What a row carries from block to block: the best language's posterior, its mean, and the largest mean and sum of shares.
_STATE = ("best", "mean", "most", "shares")


def predict(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", evidence: int = 50) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row. The model's table isn't read after the call."""
    spark, keep = df.sparkSession, tuple(c for c in keep if c not in ("lang_pred", "score"))
    inner = tuple(f"k{i}" for i in range(len(keep)))
    rows = df.select(*(c.alias(n) for n, c in zip((*inner, "body"), columns(*keep, text))))
    pred, state = T.StructField("pred", T.StringType()), [T.StructField(n, T.DoubleType()) for n in _STATE]
    table = path = None
    for names, matrix in model.blocks():
        if table is not None:
            rows, fresh = materialize(rows, "language-rows")
            table.unpersist()
            if path:
                drop_table(spark, path)
            path = fresh
        table = spark.sparkContext.broadcast((names, matrix))
        carried = ("pred", *_STATE) if "pred" in rows.columns else ()
        rows = map_texts(rows, (*inner, "body", *carried), "body", _scores(table, evidence, len(carried)), [T.StructField(f"new_{f.name}", f.dataType) for f in (pred, *state)])
        rows = rows.select(*inner, "body", *(F.col(f"new_{n}").alias(n) for n in ("pred", *_STATE)))
    if table is None:
        return rows.select(*inner, F.lit(UNKNOWN), F.lit(0.0)).toDF(*keep, "lang_pred", "score")
    score = F.when(F.col("pred").isNull(), 0.0).otherwise(F.least(F.exp(F.col("mean") - F.col("most")) / F.col("shares"), F.lit(1.0)))
    return rows.select(*inner, F.coalesce("pred", F.lit(UNKNOWN)), score).toDF(*keep, "lang_pred", "score")


def _scores(table: Broadcast, evidence: int, carried: int):
    """The best language of a block and those before it; pred is null for texts without letters."""
    out = [T.StructField("pred", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in _STATE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = table.value
        buckets = matrix.shape[1] - 1
        for batch in sliced(batches, "text", SLICE):
            texts = [letters(t) for t in batch.column("text").to_pylist()]
            ids, owner = grams(texts, buckets)
            n = np.bincount(owner, minlength=len(texts))
            total = np.stack([np.bincount(owner, weights=row[ids], minlength=len(texts)) for row in matrix[:, :buckets]])
            prior = matrix[:, buckets:].astype(np.float64)
            posterior = total + prior
            at = (posterior.argmax(0), np.arange(len(texts)))
            mean = total / np.maximum(n, 1) * np.minimum(n, evidence) + prior
            most = mean.max(0)
            pred, found = np.array(names, object)[at[0]], [posterior[at], mean[at], most, np.exp(mean - most).sum(0)]
            if carried:
                before = batch.num_columns - 1 - carried
                old_pred = np.array(batch.column(before).to_pylist(), object)
                old = [batch.column(before + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(_STATE))]
                # Of languages that tie the first in order stays.
                stays = old[0] >= found[0]
                top = np.maximum(old[2], most)
                shares = old[3] * np.exp(old[2] - top) + found[3] * np.exp(most - top)
                pred, found = np.where(stays, old_pred, pred), [np.where(stays, old[0], found[0]), np.where(stays, old[1], found[1]), top, shares]
            pred = pa.array([p if k else None for p, k in zip(pred.tolist(), n.tolist())], pa.string())
            yield added(batch, out, [pred, *(pa.array(v, pa.float64()) for v in found)])

    return run
