"""Queries of monitoring (MO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textengine.operators import monitor as M

from . import neighbours as N
from . import views as S
from .registry import VIEWS, query

VIEWS["v_ref"] = "SELECT * FROM v_pred WHERE version = 'v1'"
VIEWS["v_live"] = "SELECT * FROM v_pred WHERE version = 'v2'"
VIEWS["v_psi"] = "SELECT sum((a - e) * ln(a / e)) AS psi FROM (SELECT greatest(r.s, 1e-4) AS e, greatest(coalesce(l.s, 0.0), 1e-4) AS a FROM (SELECT queue, count(*) / (SELECT count(*) FROM v_ref)::DOUBLE AS s FROM v_ref GROUP BY queue) r LEFT JOIN (SELECT queue, count(*) / (SELECT count(*) FROM v_live)::DOUBLE AS s FROM v_live GROUP BY queue) l USING (queue))"


def ref(spark, d):
    return S.predictions(spark, d).where(F.col("version") == "v1")


def live(spark, d):
    return S.predictions(spark, d).where(F.col("version") == "v2")


@query("mo_01_reference_stats", "SELECT count(*) AS rows, round(avg((nearest < 0.3)::INT::DOUBLE), 6) AS unfamiliar_share, round(avg(confidence), 6) AS mean_confidence, round(avg(auto::INT::DOUBLE), 6) AS auto_rate FROM v_ref")
def mo_01(spark, d):
    return M.reference_stats(ref(spark, d))


@query("mo_02_psi", "SELECT round(psi, 6) AS psi FROM v_psi")
def mo_02(spark, d):
    return M.psi(M.mix(ref(spark, d)), M.mix(live(spark, d))).select(F.round("psi", 6).alias("psi"))


@query(
    "mo_03_drift_report",
    """WITH s AS (SELECT (SELECT psi FROM v_psi) AS psi, (SELECT avg((nearest < 0.3)::INT::DOUBLE) FROM v_live) - (SELECT avg((nearest < 0.3)::INT::DOUBLE) FROM v_ref) AS rise, (SELECT avg(confidence) FROM v_ref) - (SELECT avg(confidence) FROM v_live) AS fall,
    (SELECT count(*) FROM v_live) AS predictions, (SELECT avg(agreed::INT::DOUBLE) FROM v_fb) AS acc, (SELECT count(*) FROM v_fb) AS nf),
    l AS (SELECT *, CASE WHEN psi >= 0.2 THEN 2 WHEN psi >= 0.1 THEN 1 ELSE 0 END AS a, CASE WHEN rise >= 0.1 THEN 2 WHEN rise >= 0.05 THEN 1 ELSE 0 END AS b, CASE WHEN fall >= 0.05 THEN 1 ELSE 0 END AS c, CASE WHEN nf >= 50 AND acc < 0.85 THEN 2 ELSE 0 END AS e FROM s)
    SELECT CASE WHEN predictions < 200 THEN 'insufficient_data' ELSE ['ok', 'warn', 'drift'][greatest(a, b, c, e) + 1] END AS status, predictions, round(psi, 4) AS psi, round(rise, 4) AS rise, round(fall, 4) AS fall, round(CASE WHEN nf >= 50 THEN acc END, 4) AS live_accuracy,
    array_to_string(list_filter([CASE WHEN a > 0 THEN 'queue mix' END, CASE WHEN b > 0 THEN 'unfamiliar' END, CASE WHEN c > 0 THEN 'confidence' END, CASE WHEN e > 0 THEN 'live accuracy' END], lambda x: x IS NOT NULL), ',') AS reasons FROM l""",
)
def mo_03(spark, d):
    return M.drift_report(live(spark, d), S.feedback(spark, d), ref(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@query("mo_04_language_mix", "SELECT language AS key, round(count(*) / (SELECT count(*) FROM v_live)::DOUBLE, 6) AS share FROM v_live GROUP BY language")
def mo_04(spark, d):
    return M.mix(live(spark, d), "language").select("key", F.round("share", 6).alias("share"))


@query("mo_05_live_accuracy", "SELECT p.queue, p.language, count(*) AS n, round(avg(f.agreed::INT::DOUBLE), 6) AS accuracy FROM v_fb f JOIN v_pred p ON p.id = f.ticket_id GROUP BY ROLLUP (p.queue, p.language)")
def mo_05(spark, d):
    return M.live_accuracy(S.feedback(spark, d), S.predictions(spark, d))


@query("mo_06_audit_questions", "SELECT 'german' AS question, CAST(api_key AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM v_pred WHERE language = 'de' GROUP BY api_key UNION ALL SELECT 'confidence', version, round(avg(confidence), 6) FROM v_pred GROUP BY version UNION ALL SELECT 'corrected', CASE WHEN p.nearest < 0.3 THEN 'unfamiliar' ELSE 'familiar' END, round(avg((NOT f.agreed)::INT::DOUBLE), 6) FROM v_fb f JOIN v_pred p ON p.id = f.ticket_id GROUP BY 2")
def mo_06(spark, d):
    p, fb = S.predictions(spark, d), S.feedback(spark, d).select(F.col("ticket_id").alias("id"), "agreed")
    german = p.where(F.col("language") == "de").groupBy(F.col("api_key").cast("string").alias("key")).agg(F.count("*").cast("double").alias("value"))
    confidence = p.groupBy(F.col("version").alias("key")).agg(F.round(F.avg("confidence"), 6).alias("value"))
    corrected = fb.join(p, "id").groupBy(F.when(F.col("nearest") < 0.3, "unfamiliar").otherwise("familiar").alias("key")).agg(F.round(F.avg((~F.col("agreed")).cast("double")), 6).alias("value"))
    name = lambda df, q: df.select(F.lit(q).alias("question"), "key", "value")
    return name(german, "german").union(name(confidence, "confidence")).union(name(corrected, "corrected"))


@query("mo_07_stage_latency", "SELECT language, stage, count(*) AS n, round(quantile_cont(ms, 0.5), 4) AS median, min(ms) AS least, max(ms) AS most FROM (SELECT language, 'score' AS stage, confidence * 10 AS ms FROM v_pred UNION ALL SELECT language, 'embed', nearest * 100 FROM v_pred) GROUP BY language, stage")
def mo_07(spark, d):
    stages = F.create_map(F.lit("score"), F.col("confidence") * 10, F.lit("embed"), F.col("nearest") * 100)
    return M.stage_latency(S.predictions(spark, d).withColumn("stage_ms", stages), "language")


@query("mo_08_bucket_hist", "SELECT le, count(*) FILTER (confidence <= le) AS n FROM v_pred, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9, 1.0]) AS le) e GROUP BY le")
def mo_08(spark, d):
    return M.bucket_hist(S.predictions(spark, d), "confidence", (0.1, 0.25, 0.5, 0.75, 0.9, 1.0))


@query("mo_09_run_history", "SELECT model_version, status, fit_s + embed_s AS seconds, round(val_accuracy - lag(val_accuracy) OVER (ORDER BY day), 6) AS change FROM v_runs")
def mo_09(spark, d):
    return M.run_history(S.runs(spark, d), ["fit_s", "embed_s"]).select("model_version", "status", "seconds", F.round("change", 6).alias("change"))


@query("mo_10_decision_rows", "SELECT q_id, pred, round(conf, 4) AS confidence, conf >= 0.7 AS auto, 0.7::DOUBLE AS threshold, 'v2' AS version, sim AS familiarity FROM v_dpred")
def mo_10(spark, d):
    n = N.dn(spark, d)
    meta = n.where(F.col("rank") == 1).select("q_id", F.col("sim").alias("familiarity"))
    return M.decision_rows(N.E.knn_vote(n, 10, 4), meta, 0.7, "v2").drop("top3")
