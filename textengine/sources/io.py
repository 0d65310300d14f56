"""Sources and sinks (SC)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textengine.scratch import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of an append-only cache; broken lines are skipped, the last write of a key wins."""
    rows = spark.read.schema("source string, target string, seq long").option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("source").isNotNull()).groupBy("source").agg(F.max_by("target", "seq").alias("target"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def read_results(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.json") -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", pattern).json(path).withColumn("file", F.input_file_name())


def append_rows(df: DataFrame, path: str, at: str) -> None:
    """Append to a log that is partitioned by the day of `at`."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def latest_version(runs: DataFrame) -> DataFrame:
    """The newest promoted run, all columns."""
    rows = runs.where(F.col("status") == "promoted")
    return rows.agg(F.max_by(F.struct(*runs.columns), "day").alias("r")).select("r.*")


def fingerprint(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """First 16 hex digits of a SHA-256 over count, sum and exclusive or of the row hashes (60 bits
    each) of each part: whatever the order of rows, and summed up before the shuffle."""
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"), 256)
    number = F.conv(F.left(row, F.lit(15)), 16, 10).cast("long")
    parts = df.select(F.col(by), number.alias("__row")).groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("__row").cast("decimal(38,0)")).alias("s"), F.bit_xor("__row").alias("x"))
    return parts.select(by, F.left(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")).cast("binary"), 256), F.lit(16)).alias("fingerprint"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionAll(row)
    return out
