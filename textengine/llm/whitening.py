"""Operator 13: embedding whitening with block matrices.

Entries become whole numbers x = floor(256 c). The fit list holds each distinct x once. Rows are
packed into blocks, whose centred values form a BlockMatrix; its transpose times itself is the scatter matrix,
with the middle dimension split over many tasks; the driver takes apart that matrix alone (its size
is the dimension's square), and the BlockMatrix times the whitening matrix projects all rows. All sums
before the centring are exact.

Rows whose vector is null or empty or holds null or non-finite entries are dropped, as are vectors of
another length than the commonest (the longest of those that tie), which have no place in the same space. Repeated rows
and rows with null ids are projected like any others. Without rows, or if all vectors are equal,
the result is empty; directions without variance have no component. Entries beyond a long divided by 256 take the
nearest long; a deviation beyond a long is null. Columns other than the vector and those of `keep` are ignored,
whatever their names; a kept column whose name is one of the operator's own gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, drop_table, materialize

#: Fixed value of the contract: steps of one unit of an entry.
STEPS = 256.0
#: Bytes of a block's doubles, and blocks that one task multiplies.
BLOCK_BYTES, BLOCKS_A_TASK = 1 << 20, 16
#: Components whose variance is below this share of the largest are rounding errors.
_NO_VARIANCE = 1e-12


def stepped(vector: str = "x") -> F.Column:
    """The vector's entries as whole numbers."""
    return F.transform(F.col(vector), lambda c: F.floor(F.lit(STEPS) * c.cast("double")).cast("long") + F.lit(0).cast("long"))


def usable(df: DataFrame, vector: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows with vectors of the commonest length whose entries are all finite: head, x."""
    head = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns(*keep))]) if keep else F.struct(F.lit(0).alias("none"))
    rows = df.select(head.alias("head"), *(c.alias("x") for c in columns(vector)))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0)).where(F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == F.lit(sizes[0] if sizes else 0)).select("head", stepped().alias("x"))


def blocks_of(rows: DataFrame, name: str, dim: int) -> tuple[DataFrame, str, int]:
    """Rows packed into blocks and written: block (gapless from 0), n, x (long integers, row after
    row) and heads. Also the table's place and the number of blocks."""
    size = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    head = rows.schema["head"].dataType if "head" in rows.columns else None
    fields = [T.StructField("task", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.BinaryType())]
    if head is not None:
        fields.append(T.StructField("heads", T.ArrayType(head)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, waiting = TaskContext.get().partitionId(), 0, []

        def block(table: pa.Table) -> pa.RecordBatch:
            x = np.ascontiguousarray(table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64)
            columns = [pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([len(table)], pa.int32()), pa.array([x.tobytes()], pa.binary())]
            if head is not None:
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column("head").combine_chunks()))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        held = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - held)
                waiting.append(part)
                held, at = held + part.num_rows, at + part.num_rows
                if held == size:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, held, number = [], 0, number + 1
        if held:
            yield block(pa.Table.from_batches(waiting))

    packed, path = materialize(rows.mapInArrow(pack, T.StructType(fields)), name)
    counts = dict(packed.groupBy("task").agg(F.count("*")).collect())  # one row a task
    order = sorted(counts)
    first = dict(zip(order, np.cumsum([0, *(counts[t] for t in order)]).tolist()))
    start = F.create_map(*[F.lit(v) for kv in first.items() for v in kv])[F.col("task")] if first else F.lit(0)
    return packed.withColumn("block", (start + F.col("number")).cast("int")).drop("task", "number"), path, sum(counts.values())


def sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""
    schema = "dim int, n long, high decimal(38,0), low decimal(38,0)"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            for rows, data in zip(batch.column("n").to_pylist(), batch.column("x")):
                x = np.frombuffer(data.as_buffer(), np.int64).reshape(rows, dim)
                n += rows
                part = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                total = [t + (h << 32) + low for t, h, low in zip(total, *part)]
        whole = pa.decimal128(38, 0)
        columns = [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([t >> 32 for t in total]).cast(whole), pa.array([t & 0xFFFFFFFF for t in total]).cast(whole)]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "high", "low"])

    found = blocks.select("n", "x").mapInArrow(add, schema).groupBy("dim").agg(F.sum("n"), F.sum("high"), F.sum("low")).orderBy("dim").collect()
    return int(found[0][1]), [(int(h) << 32) + int(low) for _, _, h, low in found]


def matrix_of(blocks: DataFrame, dim: int, mean: np.ndarray) -> BlockMatrix:
    """The blocks' centred rows as a distributed matrix of one column of blocks."""

    def centred(row) -> tuple:
        values = np.frombuffer(row.x, np.int64).reshape(row.n, dim) - mean
        return (row.block, 0), DenseMatrix(row.n, dim, values.ravel(), True)

    return BlockMatrix(blocks.select("block", "n", "x").rdd.map(centred), max(1, BLOCK_BYTES // (8 * dim)), dim)


def transposed_times(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    """The transpose of a tall matrix times the matrix. With the middle dimension split, each task multiplies a
    few blocks and the products are added up; else one task would get all of them."""
    left, right = matrix.transpose(), matrix
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, -(-blocks // BLOCKS_A_TASK))
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock).toLocalMatrix().toArray()


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n x - S)^2 of each row; null beyond a long."""
    most = max((abs(n * int(v) - s) for row in (x.max(0), x.min(0)) for v, s in zip(row, total)), default=0)
    if most * most * x.shape[1] < 1 << 63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = 4) -> DataFrame:
    """Project every row onto the leading components of the fit list, scaled to unit variance.

    Returns for each row and component the columns of `keep`, component (from 1, by falling
    variance), n (rows of the fit list), deviation, whitened, explained (share of the variance) and identity_error
    (largest entry of the covariance of `whitened` over the fit list minus the identity).
    """
    own = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    spark, keep = df.sparkSession, tuple(c for c in keep if c not in own)
    rows = usable(df, vector, keep)
    first = rows.select(F.size("x")).first()
    fields = [df.schema[c] for c in keep]
    types = ("int", "long", "long", "double", "double", "double")
    empty = spark.createDataFrame([], T.StructType([*fields, *(T.StructField(n, {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}[t]) for n, t in zip(own, types))]))
    if first is None:
        return empty
    dim = first[0]
    fit, fit_path, fit_blocks = blocks_of(rows.select("x").distinct(), "whitening-fit", dim)
    n, total = sums(fit, dim)
    mean = np.array([s / n for s in total])
    tall = matrix_of(fit, dim, mean)
    covariance = transposed_times(tall, fit_blocks) / n
    variance, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-variance, kind="stable")[:components]
    order = order[variance[order] > max(0.0, _NO_VARIANCE * variance[order[0]])]
    if len(order) == 0:
        return empty
    k = len(order)
    scaled = directions[:, order] / np.sqrt(variance[order])
    explained = (variance[order] / np.trace(covariance)).tolist()
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dim, k, scaled.ravel(), True))], 1), dim, k)
    error = float(np.abs(transposed_times(tall.multiply(whitening), fit_blocks) / n - np.eye(k)).max())
    drop_table(spark, fit_path)

    packed, _, _ = blocks_of(rows, "whitening-rows", dim)
    projected = matrix_of(packed, dim, mean).multiply(whitening).blocks
    values = spark.createDataFrame(projected.map(lambda b: (b[0][0], b[1].toArray().ravel().tolist())), "block int, whitened array<double>")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (size, data) in enumerate(zip(batch.column("n").to_pylist(), batch.column("x"))):
                x = np.frombuffer(data.as_buffer(), np.int64).reshape(size, dim)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column("block"), row.column("heads"), pa.array([deviations(x, n, total)], pa.list_(pa.int64()))], names=["block", "heads", "deviation"])

    schema = T.StructType([T.StructField("block", T.IntegerType()), packed.schema["heads"], T.StructField("deviation", T.ArrayType(T.LongType()))])
    both = packed.select("block", "heads", "n", "x").mapInArrow(measured, schema).join(values.hint("shuffle_hash"), "block")
    each = both.select(F.posexplode(F.arrays_zip("heads", "deviation")).alias("at", "row"), "whitened")
    numbers = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.lit(explained[c]).alias("explained")) for c in range(k)])
    each = each.select("row", "at", "whitened", F.explode(numbers).alias("of"))
    return each.select(
        *[F.col(f"row.heads.c{i}").alias(c) for i, c in enumerate(keep)],
        F.col("of.component").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("row.deviation").alias("deviation"),
        F.col("whitened")[F.col("at") * k + F.col("of.component") - 1].alias("whitened"),
        F.col("of.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
