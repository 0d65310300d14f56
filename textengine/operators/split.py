"""Splits, folds, samples and deduplication by row order (SP, DD) in deterministic hash order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.scratch import drop_table, materialize


def hash_order(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def placed(df: DataFrame, by: str | None, seed: int) -> DataFrame:
    """Add __p, the row's place (from 1) in the hash order of its class, and __nc, the rows of the class.

    Places are counted in cells, the 65,536 ranges of the hash: rows of the cells before, and the place
    within the cell. So no class, and no table without classes, is ordered in one task.
    """
    own = F.col(by) if by else F.lit(0)
    rows = df.withColumns({"__h": hash_order(seed), "__of": own}).withColumn("__cell", F.left("__h", F.lit(4)))
    sizes = rows.groupBy("__of", "__cell").agg(F.count("*").alias("__n"))
    every = W.partitionBy("__of")
    sizes = sizes.select(F.col("__of").alias("__of2"), F.col("__cell").alias("__cell2"), (F.sum("__n").over(every.orderBy("__cell")) - F.col("__n")).alias("__base"), F.sum("__n").over(every).alias("__nc"))
    rows = rows.join(sizes, F.col("__of").eqNullSafe(F.col("__of2")) & (F.col("__cell") == F.col("__cell2")))
    inside = F.row_number().over(W.partitionBy("__of", "__cell").orderBy("__h", "id"))
    return rows.withColumn("__p", F.col("__base") + inside).drop("__h", "__of", "__cell", "__of2", "__cell2", "__base")


def stratified_split(df: DataFrame, by: str, share: float, seed: int) -> DataFrame:
    """Add split: test for exactly round(share * n) rows of each stratum, else train."""
    rows = placed(df, by, seed)
    return rows.withColumn("split", F.when(F.col("__p") <= F.round(F.col("__nc") * share), "test").otherwise("train")).drop("__p", "__nc")


def assign_folds(df: DataFrame, by: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    return placed(df, by, seed).withColumn(name, ((F.col("__p") - 1) % k).cast("int")).drop("__p", "__nc")


def nested_folds(df: DataFrame, by: str, outer: int, inner: int, seed: int) -> DataFrame:
    rows = assign_folds(df, by, outer, seed, "outer_fold")
    rows = rows.withColumn("__by", F.concat_ws("|", by, "outer_fold"))
    return assign_folds(rows, "__by", inner, seed + 1, "inner_fold").drop("__by")


def stratified_subset(df: DataFrame, by: str, n: int, seed: int) -> DataFrame:
    """About n rows, round(n * n_c / N) of each class."""
    rows = placed(df, by, seed)
    total = df.agg(F.count("*").alias("__n"))
    return rows.join(F.broadcast(total)).where(F.col("__p") <= F.round(F.lit(n) * F.col("__nc") / F.col("__n"))).drop("__nc", "__p", "__n")


def sample_n(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(hash_order(seed), "id").limit(n)


def cap_per_class(df: DataFrame, by: str, n: int, seed: int) -> DataFrame:
    return placed(df, by, seed).where(F.col("__p") <= n).drop("__p", "__nc")


def growing_pools(df: DataFrame, fracs: tuple[float, ...], seed: int, by: str) -> DataFrame:
    """Rows once for each fraction whose pool holds them; larger pools hold the smaller ones."""
    rows = placed(df, by, seed).withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fracs])))
    return rows.where(F.col("__p") / F.col("__nc") <= F.col("frac")).drop("__p", "__nc")


def shuffle_labels(df: DataFrame, label: str, seed: int) -> DataFrame:
    """Labels permuted over the rows, as a control: the i-th label of one order goes to the i-th row of another."""
    labels = placed(df.select("id", label), None, seed + 1).select(F.col(label).alias("shuffled"), "__p")
    return placed(df, None, seed).join(labels, "__p").drop("__p", "__nc")


def dedup_first(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The first row of each key, found with partial results per task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*").select(df.columns)


def anti_text(df: DataFrame, other: DataFrame, key: str = "text") -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def greedy_dedup(df: DataFrame, pairs: DataFrame, order: str = "id", links_per_range: int = 200_000) -> DataFrame:
    """Rows that no kept earlier row is linked with (pairs q_id < n_id).

    Links are dealt out by ranges of their later row and read in order: within a range one pass
    decides every row whose earlier neighbours are decided, chains of any length included. What
    depends on rows of another range that are still open waits for the next round, which sees only
    links of open rows. A task keeps the decisions of its range's rows, not their links.
    """
    spark = df.sparkSession
    links, path = materialize(pairs.select(F.col("q_id").alias("a"), F.col("n_id").alias("b")).distinct(), "greedy-links")
    # Rows that are nobody's later neighbour are kept.
    first = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti").withColumn("ka", F.lit(True))
    links, opened = materialize(links.join(first, "a", "left"), "greedy-open")
    drop_table(spark, path)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bool] = {}  # of this range
        row, hit, free = None, False, True

        def close(out: list) -> None:
            if row is not None and (hit or free):
                known[row] = not hit
                out.append((row, not hit))

        for batch in batches:
            out: list[tuple[int, bool]] = []
            for a, b, kept in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ka"))):
                if b != row:
                    close(out)
                    row, hit, free = b, False, True
                kept = known.get(a) if kept is None else kept
                hit, free = hit or kept is True, free and kept is False
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.bool_())], names=["id", "kept"])
        out = []
        close(out)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.bool_())], names=["id", "kept"])

    dropped, paths = [], [opened]
    while (n := links.count()) > 0:
        ranged = links.repartitionByRange(-(-n // links_per_range), "b").sortWithinPartitions("b", "a")
        now, path = materialize(ranged.select(F.col("a").cast("long"), F.col("b").cast("long"), "ka").mapInArrow(decide, "id long, kept boolean"), "greedy-decided")
        dropped.append(now.where(~F.col("kept")).select("id"))
        left = links.join(now.select(F.col("id").alias("b")), "b", "left_anti").join(now.select(F.col("id").alias("a"), F.col("kept").alias("k")), "a", "left")
        links, opened = materialize(left.select("a", "b", F.coalesce("ka", "k").alias("ka")), "greedy-open")
        drop_table(spark, paths.pop())
        paths.append(opened)
    drop_table(spark, paths.pop())
    return df.join(reduce(DataFrame.unionAll, dropped), "id", "left_anti") if dropped else df


def drop_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Add reason: the first that holds, else kept."""
    return df.withColumn("reason", F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons.items()], F.lit("kept")))


def filter_siblings(df: DataFrame, copies: float = 0.92, drifted: float = 0.15) -> DataFrame:
    """Rows (id, text, sim to their source) with reason: copy, drifted, duplicate or kept."""
    rows = drop_reasons(df, {"copy": F.col("sim") >= copies, "drifted": F.col("sim") < drifted})
    n = F.row_number().over(W.partitionBy("reason", "text").orderBy("id"))
    return rows.withColumn("reason", F.when((F.col("reason") == "kept") & (n > 1), "duplicate").otherwise(F.col("reason")))
