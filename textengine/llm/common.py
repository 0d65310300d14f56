"""Helpers shared by the training-data operators: shared scratch tables and word rules."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textengine.scratch import drop_table, materialize, shared_dir  # noqa: F401 (the operators take them from here)

#: Words of every contract: runs of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str) -> list[str]:
    """Words of a text. str.split() is faster and agrees unless a rarer blank occurs."""
    return WORD.findall(text) if _OTHER_BLANKS.search(text) else text.split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(*names: str) -> list[Column]:
    """Columns of these very names, whatever dots and backticks are in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def map_texts(df: DataFrame, keep: tuple[str, ...], text: str, run: Callable, fields: list[T.StructField]) -> DataFrame:
    """df's columns `keep` and the fields that run() adds to batches of them and, as the last column, "text".

    Inside, columns have names of their own, as Spark's Arrow functions don't take every name.
    """
    inner = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*[c.alias(n) for n, c in zip((*inner, "text"), columns(*keep, text))])
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for n, c in zip(inner, keep)), *fields])

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return rows.mapInArrow(trimmed, schema).toDF(*keep, *(f.name for f in fields))


def give_back() -> None:
    """Return what a task has freed to the system: its worker serves later tasks and would hold it for them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def added(batch: pa.RecordBatch, fields: list[T.StructField], columns: list[pa.Array]) -> pa.RecordBatch:
    """A batch of map_texts() with the fields in the place of the text."""
    n = batch.num_columns - 1
    return pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*batch.schema.names[:n], *(f.name for f in fields)])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of jobs that are done: it does so once the
    driver has collected their handles, which else may take as long as the next jobs."""
    gc.collect()
    spark._jvm.System.gc()


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a text column holds about most_bytes, or one row."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = batch.num_rows - at
            while n > 1 and batch.slice(at, n).column(column).nbytes > most_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array without nulls."""
    wide = pa.types.is_large_binary(strings.type) or pa.types.is_large_string(strings.type)
    offsets = np.frombuffer(strings.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]
