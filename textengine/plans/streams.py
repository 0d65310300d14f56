"""Queries that run streams over the given tables to their end (ST), with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from textengine.sources import io as IO
from textengine.streaming import jobs as J

from . import views as S
from .registry import query


def stream(spark, d, rows=None):
    """The audit log as a directory of files, read as a stream."""
    rows = S.predictions(spark, d) if rows is None else rows
    rows = rows.withColumn("created_at", F.col("created_at").cast("timestamp"))
    path = IO.scratch(spark, "stream")
    rows.repartitionByRange(4, "created_at").sortWithinPartitions("created_at").write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("st_01_route_stream", "SELECT id, queue AS pred, confidence >= 0.8 AS auto FROM v_pred")
def st_01(spark, d):
    path = J.route_stream(stream(spark, d), lambda b: b.select("id", F.col("queue").alias("pred"), (F.col("confidence") >= 0.8).alias("auto")), "routed")
    return spark.read.parquet(path).select("id", "pred", "auto")


@query("st_02_metrics_stream", "SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H') AS start, queue, auto, count(*) AS n FROM v_pred GROUP BY ALL")
def st_02(spark, d):
    rows = J.run_to_end(J.metrics_stream(stream(spark, d)), "metrics", "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "queue", "auto", "n")


@query("st_03_drift_stream", "SELECT strftime(s, '%Y-%m-%d') AS start, count(*) AS n, round(avg((nearest < 0.3)::INT::DOUBLE), 6) AS unfamiliar, round(avg(confidence), 6) AS confidence FROM v_pred, (SELECT unnest(range(0, 7)) AS k), LATERAL (SELECT date_trunc('day', created_at) - to_days(CAST(k AS INTEGER)) AS s) GROUP BY s")
def st_03(spark, d):
    rows = J.run_to_end(J.drift_stream(stream(spark, d)), "drift", "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.round("unfamiliar", 6).alias("unfamiliar"), F.round("confidence", 6).alias("confidence"))


@query(
    "st_04_throttle",
    """WITH RECURSIVE e AS (SELECT api_key, id, CAST(floor(epoch(created_at)) AS BIGINT) AS t FROM v_pred), a AS (SELECT api_key, arg_min(id, (t, id)) AS id, min(t) AS t FROM e GROUP BY api_key
    UNION ALL SELECT e.api_key, arg_min(e.id, (e.t, e.id)), min(e.t) FROM a JOIN e ON e.api_key = a.api_key AND e.t > a.t + 3600 GROUP BY e.api_key)
    SELECT api_key, id, id IN (SELECT id FROM a) AS admitted FROM e""",
)
def st_04(spark, d):
    return J.run_to_end(J.throttle(stream(spark, d), 1, 3600), "throttle")


@query("st_05_feedback_join", "SELECT f.id, f.ticket_id, p.queue AS p_queue FROM v_fb f LEFT JOIN v_pred p ON p.id = f.ticket_id AND f.created_at >= p.created_at")
def st_05(spark, d):
    """Dead letters only leave a stream once the watermark has passed them, so later events than
    all others, one in each of two further files, close both sides."""
    p, f = S.predictions(spark, d), S.feedback(spark, d)
    last = p.agg(F.max("created_at").alias("m"))
    late = lambda df, key: df.limit(1).crossJoin(last).select(*[F.timestamp_add("DAY", F.lit(200), F.col("m")).alias("created_at") if c == "created_at" else F.lit(-1).cast("long").alias(c) if c == key else c for c in df.columns])
    p, f = p.unionByName(late(p, "id")), f.unionByName(late(f, "id").withColumn("ticket_id", F.lit(-1).cast("long")))
    rows = J.run_to_end(J.feedback_join(stream(spark, d, p), stream(spark, d, f)), "joined")
    return rows.where(F.col("id") != -1).select("id", "ticket_id", "p_queue")


@query("st_06_dedup_stream", "SELECT id FROM v_pred")
def st_06(spark, d):
    p = S.predictions(spark, d)
    twice = p.unionByName(p.where(F.col("id") % 3 == 0))
    return J.run_to_end(J.dedup_stream(stream(spark, d, twice).select("id", "created_at")), "once").select("id")


@query("st_07_latest_version", "SELECT id, (SELECT arg_max(model_version, day) FROM v_runs WHERE status = 'promoted') AS model_version FROM v_pred")
def st_07(spark, d):
    path = J.route_stream(stream(spark, d), lambda b: J.with_latest_version(b.select("id"), lambda s: S.runs(s, d)), "versions")
    return spark.read.parquet(path).select("id", "model_version")
