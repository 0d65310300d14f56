"""Cutting lineage without local checkpoints: tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="textengine-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes of an Arrow batch while large rows go through Python: a task holds a batch several times over.
BATCH = 8 << 20


@contextmanager
def _batches(spark: SparkSession, most: int | None) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if most:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, batch_bytes: int | None = None) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read back; batch_bytes: of Arrow batches in that job."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # Parquet looks at what it holds every hundred rows, unless told otherwise, and holds 128 MB.
    small = {"parquet.block.size": batch_bytes, "parquet.page.size.row.check.min": 1, "compression": "zstd"} if batch_bytes else {}
    with _batches(df.sparkSession, batch_bytes):
        df.write.options(**small).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_written(df: DataFrame) -> None:
    """Delete the table of materialize() that df reads, when nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_table(df.sparkSession, folder)
