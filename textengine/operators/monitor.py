"""Monitoring of routing decisions (MO)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Limits of the drift report.
UNFAMILIAR, MIN_ROWS = 0.3, 200
PSI_WARN, PSI_DRIFT = 0.1, 0.2
RISE_WARN, RISE_DRIFT = 0.05, 0.10
FALL_WARN, LIVE_FLOOR, MIN_FEEDBACK = 0.05, 0.85, 50


def reference_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.round(F.avg((F.col("nearest") < UNFAMILIAR).cast("double")), 6).alias("unfamiliar_share"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.avg(F.col("auto").cast("double")), 6).alias("auto_rate"),
    )


def mix(df: DataFrame, column: str = "queue") -> DataFrame:
    n = df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    return n.select("key", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


def psi(reference: DataFrame, live: DataFrame, eps: float = 1e-4) -> DataFrame:
    """One row: population stability of live (key, share) over the reference's categories."""
    rows = reference.join(live.withColumnRenamed("share", "actual"), "key", "left")
    e, a = F.greatest("share", F.lit(eps)), F.greatest(F.coalesce("actual", F.lit(0.0)), F.lit(eps))
    return rows.agg(F.coalesce(F.sum((a - e) * F.log(a / e)), F.lit(0.0)).alias("psi"))


def drift_report(live: DataFrame, feedback: DataFrame, reference: DataFrame | None) -> DataFrame:
    """One row: status (unknown, insufficient_data, ok, warn, drift), the signals and the reasons."""
    n = live.agg(F.count("*").alias("predictions")).crossJoin(feedback.agg(F.count("*").alias("n_feedback"), F.avg(F.col("agreed").cast("double")).alias("live_accuracy")))
    if reference is None:
        return n.select(F.lit("unknown").alias("status"), "predictions", F.lit(None).cast("double").alias("psi"), F.lit(None).cast("double").alias("rise"), F.lit(None).cast("double").alias("fall"), F.lit(None).cast("double").alias("live_accuracy"), F.array(F.lit("no reference")).alias("reasons"))
    stats = lambda df, p: df.agg(F.avg((F.col("nearest") < UNFAMILIAR).cast("double")).alias(f"{p}_unfamiliar"), F.avg("confidence").alias(f"{p}_confidence"))
    row = n.crossJoin(stats(reference, "ref")).crossJoin(stats(live, "live")).crossJoin(psi(mix(reference), mix(live)))
    rise, fall = F.col("live_unfamiliar") - F.col("ref_unfamiliar"), F.col("ref_confidence") - F.col("live_confidence")
    judged = F.col("n_feedback") >= MIN_FEEDBACK
    level = lambda c, warn, drift: F.when(c >= drift, 2).when(c >= warn, 1).otherwise(0)
    levels = {
        "queue mix": level(F.col("psi"), PSI_WARN, PSI_DRIFT),
        "unfamiliar": level(rise, RISE_WARN, RISE_DRIFT),
        "confidence": F.when(fall >= FALL_WARN, 1).otherwise(0),
        "live accuracy": F.when(judged & (F.col("live_accuracy") < LIVE_FLOOR), 2).otherwise(0),
    }
    worst = F.greatest(*levels.values())
    status = F.when(F.col("predictions") < MIN_ROWS, "insufficient_data").otherwise(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("drift")), worst + 1))
    reasons = F.array_compact(F.array(*[F.when(lv > 0, F.lit(name)) for name, lv in levels.items()]))
    return row.select(status.alias("status"), "predictions", F.round("psi", 4).alias("psi"), F.round(rise, 4).alias("rise"), F.round(fall, 4).alias("fall"), F.round(F.when(judged, F.col("live_accuracy")), 4).alias("live_accuracy"), reasons.alias("reasons"))


def live_accuracy(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Share of agreed corrections overall, by class and by class and language (rollup)."""
    rows = feedback.select(F.col("ticket_id").alias("id"), "agreed").join(predictions.select("id", "queue", "language"), "id")
    return rows.rollup("queue", "language").agg(F.count("*").alias("n"), F.round(F.avg(F.col("agreed").cast("double")), 6).alias("accuracy"))


def stage_latency(rows: DataFrame, by: str) -> DataFrame:
    """Median, least and most milliseconds per stage of a map column stage_ms."""
    tall = rows.select(by, F.explode("stage_ms").alias("stage", "ms"))
    return tall.groupBy(by, "stage").agg(F.count("*").alias("n"), F.round(F.percentile("ms", 0.5), 4).alias("median"), F.min("ms").alias("least"), F.max("ms").alias("most"))


def bucket_hist(df: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """(le, n): cumulative counts up to each edge."""
    rows = df.select(value, F.explode(F.array(*[F.lit(float(e)) for e in edges])).alias("le"))
    return rows.groupBy("le").agg(F.count_if(F.col(value) <= F.col("le")).alias("n"))


def run_history(runs: DataFrame, stages: list[str]) -> DataFrame:
    """Runs in order with their total seconds and the change of accuracy since the last one."""
    total: Column = sum((F.col(c) for c in stages), F.lit(0.0))
    return runs.withColumns({"seconds": total, "change": F.col("val_accuracy") - F.lag("val_accuracy").over(W.orderBy("day"))})


def decision_rows(probs: DataFrame, meta: DataFrame, threshold: float, version: str) -> DataFrame:
    from .decide import decide

    rows = decide(probs, threshold).join(meta, "q_id", "left")
    return rows.select("q_id", "pred", F.round("confidence", 4).alias("confidence"), "top3", "auto", F.lit(threshold).alias("threshold"), F.lit(version).alias("version"), *[c for c in meta.columns if c != "q_id"])
