"""Structured Streaming jobs (ST); each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from textengine.scratch import drop_table, materialize
from textengine.sources.io import scratch

LATE = "10 minutes"


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all that is there into a table of the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if mode == "append":
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    else:
        def put(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def route_stream(stream: DataFrame, route: Callable[[DataFrame], DataFrame], name: str) -> str:
    """Score each micro-batch and write its decisions under its batch id: a repeated batch
    overwrites its own part. Returns the folder."""
    path = scratch(stream.sparkSession, name)

    def put(batch: DataFrame, batch_id: int) -> None:
        route(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.option("checkpointLocation", f"{path}-state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return path


def metrics_stream(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts per window, class and routing."""
    w = F.window("created_at", width)
    return stream.withWatermark("created_at", LATE).groupBy(w, "queue", "auto").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "queue", "auto", "n")


def drift_stream(stream: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Signals of the drift report per sliding window."""
    w = F.window("created_at", width, slide)
    return stream.withWatermark("created_at", LATE).groupBy(w).agg(F.count("*").alias("n"), F.avg((F.col("nearest") < 0.3).cast("double")).alias("unfamiliar"), F.avg("confidence").alias("confidence")).select(F.col("window.start").alias("start"), "n", "unfamiliar", "confidence")


def throttle(stream: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Sliding-log limiter: an event is admitted if fewer than `limit` admitted ones lie in the last
    `seconds` (one exactly that old still counts). State per key is at most `limit` times."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        ok = []
        for t in rows["t"].tolist():
            log = [x for x in log if x >= t - seconds]
            ok.append(len(log) < limit)
            if ok[-1]:
                log.append(t)
        state.update((log,))
        yield pd.DataFrame({"api_key": key[0], "id": rows["id"].to_numpy(), "admitted": ok})

    rows = stream.select("api_key", "id", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("t"))
    return rows.groupBy("api_key").applyInPandasWithState(step, "api_key long, id long, admitted boolean", "log array<long>", "append", GroupStateTimeout.NoTimeout)


def throttle_once(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Batch twin of throttle() for a limit of one: (api_key, id, admitted), with a hot key's events in many tasks.

    Each event points at the first one more than `seconds` later, found in buckets of `seconds` + 1: in
    the next bucket, or else at the head of the next bucket that has any. Admitted are each key's first event and
    what its pointers lead to; pointers double their length every round, so a chain of n takes log n rounds.
    """
    spark = events.sparkSession
    rows = events.select("api_key", "id", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("t"))
    rows, rows_path = materialize(rows.withColumn("bucket", F.floor(F.col("t") / (seconds + 1)).cast("long")), "throttle-rows")
    heads = rows.groupBy("api_key", "bucket").agg(F.min(F.struct("t", "id")).alias("head"))
    in_order = W.partitionBy("api_key").orderBy("bucket")
    later = heads.select("api_key", F.col("bucket").alias("of"), F.lead("bucket").over(in_order).alias("b1"), F.lead("head").over(in_order).alias("h1"), F.lead("head", 2).over(in_order).alias("h2"))
    # Questions stand among the next bucket's events at the last time that is still too early.
    asked = rows.select("api_key", F.col("id").alias("asks"), (F.col("t") + seconds).alias("t"), (F.col("bucket") + 1).alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"))
    there = rows.select("api_key", F.lit(None).cast("long").alias("asks"), "t", "bucket", F.lit(0).alias("kind"), "id")
    after = W.partitionBy("api_key", "bucket").orderBy("t", "kind", "id").rowsBetween(0, W.unboundedFollowing)
    near = there.union(asked).withColumn("next", F.first("id", ignorenulls=True).over(after)).where(F.col("kind") == 1)
    near = near.select("api_key", F.col("asks").alias("id"), (F.col("bucket") - 1).alias("of"), "next").join(later, ["api_key", "of"])
    beyond = F.when(F.col("b1") > F.col("of") + 1, F.col("h1.id")).otherwise(F.col("h2.id"))
    jump, jump_path = materialize(near.select("api_key", "id", F.coalesce("next", beyond).alias("next")).where(F.col("next").isNotNull()), "throttle-jump")
    reached, path = materialize(rows.groupBy("api_key").agg(F.min_by("id", F.struct("t", "id")).alias("id")), "throttle-reached")
    while not jump.isEmpty():
        more = reached.join(jump, ["api_key", "id"]).select("api_key", F.col("next").alias("id"))
        wider, wider_path = materialize(reached.union(more).distinct(), "throttle-reached")
        twice = jump.join(jump.select("api_key", F.col("id").alias("next"), F.col("next").alias("far")), ["api_key", "next"])
        longer, longer_path = materialize(twice.select("api_key", "id", F.col("far").alias("next")), "throttle-jump")
        for old in (path, jump_path):
            drop_table(spark, old)
        reached, path, jump, jump_path = wider, wider_path, longer, longer_path
    found, _ = materialize(rows.join(reached.withColumn("hit", F.lit(True)), ["api_key", "id"], "left").select("api_key", "id", F.coalesce("hit", F.lit(False)).alias("admitted")), "throttle-found")
    for old in (rows_path, path, jump_path):
        drop_table(spark, old)
    return found


def feedback_join(predictions: DataFrame, feedback: DataFrame, days: int = 30) -> DataFrame:
    """Feedback with its prediction, as streams; feedback that finds none within the horizon comes out
    with nulls (dead letters)."""
    p = predictions.withWatermark("created_at", LATE).select(F.col("id").alias("p_id"), F.col("created_at").alias("p_at"), F.col("queue").alias("p_queue"))
    f = feedback.withWatermark("created_at", LATE).select("id", "ticket_id", "agreed", F.col("created_at").alias("f_at"))
    near = (F.col("ticket_id") == F.col("p_id")) & (F.col("f_at") >= F.col("p_at")) & (F.col("f_at") <= F.col("p_at") + F.expr(f"INTERVAL {days} DAYS"))
    return f.join(p, near, "left_outer")


def dedup_stream(stream: DataFrame, key: str = "id") -> DataFrame:
    return stream.withWatermark("created_at", LATE).dropDuplicatesWithinWatermark([key])


def with_latest_version(batch: DataFrame, read_runs: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """Each micro-batch reads the registry anew; the newest promoted version is one row."""
    from textengine.sources.io import latest_version

    return batch.crossJoin(F.broadcast(latest_version(read_runs(batch.sparkSession)).select("model_version")))
