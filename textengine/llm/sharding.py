"""Operator 5: shard with a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn exactly: partition after
partition takes its rows from what is left of the shards, a multivariate hypergeometric draw.
Every partition then deals its rows by a seeded permutation of these labels, one exchange brings
the rows to their shards, and a second seeded order gives the places there. The result is a
uniform shuffle, with shard sizes (law `rows`) that differ by one at most.

The driver holds only the matrix (partitions x shards counts). A shard is ordered in cells of
about `cell_rows` rows, so its size is no limit of a task. The input is read twice and must be
the same both times, which a scan of files is; a partition that holds other rows than counted
fails the job.

Nulls are values like any other, repeated rows go their own ways, an empty table gives an empty
result, and all columns of df stay, whatever their names; shard and slot replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def draw_marked(rng: np.random.Generator, marked: int, others: int, n: int) -> int:
    """Hypergeometric draw for any counts: marked ones among n of marked + others.

    Probabilities relative to the mode follow from the ratios of neighbours; beyond 14 standard
    deviations nothing is left that a double could hold.
    """
    total = marked + others
    low, high = max(0, n - others), min(n, marked)
    if low == high:
        return low
    p = marked / total
    spread = int(14 * (n * p * (1 - p)) ** 0.5) + 60
    mode = min(high, max(low, (n + 1) * (marked + 1) // (total + 2)))
    up = np.arange(mode, min(high, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    rise = np.cumprod((marked - up) * (n - up) / ((up + 1) * (others - n + up + 1)))
    fall = np.cumprod(down * (others - n + down) / ((marked - down + 1) * (n - down + 1)))
    weight = np.concatenate((fall[::-1], [1.0], rise))
    at = np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right")
    return int(mode - len(fall) + min(at, len(weight) - 1))


def communication_matrix(counts: list[int], capacity: list[int], seed: int) -> np.ndarray:
    """Rows: partitions with these counts; columns: shards with this capacity."""
    rng, left = np.random.default_rng(seed), list(capacity)
    out = np.zeros((len(counts), len(capacity)), np.int64)
    for p, n in enumerate(counts):
        if sum(left) < 10**9:
            out[p] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            others = sum(left)
            for s, marked in enumerate(left):
                others -= marked
                out[p, s] = k = draw_marked(rng, marked, others, n) if n else 0
                n -= k
        left = [a - int(b) for a, b in zip(left, out[p])]
    return out


def shuffle_into_shards(df: DataFrame, shards: int = 40, seed: int = 11, cell_rows: int = 4000) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (place in the shard, gapless from 0)."""
    df = df.drop("shard", "slot")
    own_names, df = df.columns, df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cell_name, key_name, shard_of, cell_of, start = "cell", "key", "shard_of", "cell_of", "start"
    found = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    total = sum(found.values())
    parts = sorted(found)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    drawn = communication_matrix([found[p] for p in parts], capacity, seed)
    spark = df.sparkSession
    matrix = spark.sparkContext.broadcast({p: drawn[i].astype(np.int64) for i, p in enumerate(parts)})
    cells = max(1, -(-total // (shards * cell_rows)))
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(cell_name, T.IntegerType()), T.StructField(key_name, T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        row = matrix.value.get(p, np.zeros(shards, np.int64))
        rng = np.random.default_rng([seed, p])
        labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), row))
        at = 0
        for batch in batches:
            n = batch.num_rows
            if at + n > len(labels):
                raise RuntimeError("a partition holds more rows than were counted; checkpoint the input first")
            keys = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
            cell = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[at : at + n]), pa.array(cell), pa.array(keys)], names=[*names, "shard", cell_name, key_name])
            at += n
        if at != len(labels):
            raise RuntimeError("a partition holds fewer rows than were counted; checkpoint the input first")

    dealt = df.mapInArrow(deal, schema)
    # The cells' sizes follow from the seeds alone: the same draws as in deal(), without the rows.
    counted = spark.createDataFrame([(int(p), int(found[p])) for p in parts], "p int, n long").repartition(max(1, min(len(parts), 200)), "p")

    def cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = np.random.default_rng([seed, p])
                labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), matrix.value[p]))
                keys = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
                cell = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
                both, c = np.unique(labels.astype(np.int64) * cells + cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((both // cells).astype(np.int32)), pa.array((both % cells).astype(np.int32)), pa.array(c.astype(np.int64))], names=["s", "c", "n"])

    sizes = counted.mapInArrow(cell_counts, "s int, c int, n long").groupBy("s", "c").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy("s").orderBy("c")) - F.col("n")
    starts = sizes.select(F.col("s").alias(shard_of), F.col("c").alias(cell_of), before.alias(start))
    rank = F.row_number().over(W.partitionBy("shard", cell_name).orderBy(key_name))
    placed = dealt.withColumn("slot", rank.cast("long") - 1)
    met = placed.join(starts, (F.col("shard") == F.col(shard_of)) & (F.col(cell_name) == F.col(cell_of)))
    return met.select(*names, "shard", F.col("slot") + F.col(start)).toDF(*own_names, "shard", "slot")
