"""Inputs of the queries, derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textengine.functions import text as X

from .registry import VIEWS

WS = X.WS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out once where the table has less than a split for every core, by the plan's own estimate of
    its bytes: its few row groups would else all be cleaned by one task. Larger tables stay as they are, and those
    that have a file for every core."""
    spark = df.sparkSession
    if len(df.inputFiles()) >= spark.sparkContext.defaultParallelism:
        return df
    cores, split = spark.sparkContext.defaultParallelism, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if held < cores * split else df


def tickets(spark: SparkSession, d: str) -> DataFrame:
    """documents as tickets: the first line is the subject, labels give type and priority."""
    docs, labels = spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang")), table(spark, d, "labels")
    at = F.instr("text", "\n")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("subject"),
        F.when(at > 0, F.substring("text", at + 1, F.length("text"))).otherwise(F.lit("")).alias("body"),
        F.col("source").alias("queue"),
        F.col("lang").alias("language"),
        F.col("quality").alias("type"),
        F.col("toxic").alias("priority"),
    )


VIEWS["v_tickets"] = r"""SELECT d.doc_id AS id,
 CASE WHEN instr(d.text, chr(10)) > 0 THEN substring(d.text, 1, instr(d.text, chr(10)) - 1) ELSE d.text END AS subject,
 CASE WHEN instr(d.text, chr(10)) > 0 THEN substring(d.text, instr(d.text, chr(10)) + 1) ELSE '' END AS body,
 d.source AS queue, d.lang AS language, l.quality AS type, l.toxic AS priority
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def cleaned(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    return tickets(spark, d).select("id", X.clean(F.col("subject"), F.col("body"), most).alias("text"), "queue", "language", "type", "priority")


def clean_sql(subject: str, body: str) -> str:
    text = f"lower(concat(coalesce({subject}, ''), ' . ', coalesce({body}, '')))"
    for pattern in (r"https?://\S+", r"\S+@\S+", r"\b[A-Z]{2,}-?[0-9]{3,}\b", WS + "+"):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return f"trim({text})"


VIEWS["v_clean"] = f"SELECT id, {clean_sql('subject', 'body')} AS text, queue, language, type, priority FROM v_tickets"


def pool_en(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(spark, d).where(F.col("language") == "en")


def pool_xx(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(spark, d).where(F.col("language") != "en")


VIEWS["v_en"] = "SELECT * FROM v_clean WHERE language = 'en'"
VIEWS["v_xx"] = "SELECT * FROM v_clean WHERE language <> 'en'"


def evals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), X.clean(F.lit(""), F.col("text")).alias("text"))


VIEWS["v_eval"] = f"SELECT item_id AS id, {clean_sql(chr(39) * 2, 'text')} AS text FROM benchmark"


def dense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


VIEWS["v_dense"] = "SELECT vec_id AS id, embedding AS vec, label FROM embeddings"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """events as an audit log of routing decisions."""
    k = F.get_json_object("props", "$.k").cast("int")
    confidence = F.least(F.col("value") / 100, F.lit(1.0))
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("user_id").alias("api_key"),
        F.col("event_type").alias("queue"),
        confidence.alias("confidence"),
        (k / 100).cast("double").alias("nearest"),
        F.when(F.col("event_id") % 7 == 0, "de").otherwise("en").alias("language"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "v1").otherwise("v2").alias("version"),
        (confidence >= 0.7).alias("auto"),
        F.concat(F.lit("ticket "), (F.col("event_id") % 997).cast("string")).alias("text"),
    )


VIEWS["v_pred"] = """SELECT event_id AS id, ts AS created_at, user_id AS api_key, event_type AS queue, least(value / 100, 1.0) AS confidence,
 CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS nearest, CASE WHEN event_id % 7 = 0 THEN 'de' ELSE 'en' END AS language,
 CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'v1' ELSE 'v2' END AS version, least(value / 100, 1.0) >= 0.7 AS auto,
 concat('ticket ', CAST(event_id % 997 AS VARCHAR)) AS text FROM events"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).where(F.col("id") % 5 == 0)
    correct = F.when(F.col("id") % 3 != 0, F.col("queue")).otherwise(F.lit("error"))
    return p.select(
        (F.col("id") * 10).alias("id"),
        F.timestamp_add("HOUR", (F.col("id") % 72).cast("int"), F.col("created_at")).alias("created_at"),
        F.when(F.col("id") % 50 == 0, -F.col("id")).otherwise(F.col("id")).alias("ticket_id"),
        F.col("queue").alias("predicted_queue"),
        correct.alias("correct_queue"),
        (correct == F.col("queue")).alias("agreed"),
        "api_key",
    )


VIEWS["v_fb"] = """SELECT id * 10 AS id, created_at + to_hours(CAST(id % 72 AS INTEGER)) AS created_at, CASE WHEN id % 50 = 0 THEN -id ELSE id END AS ticket_id,
 queue AS predicted_queue, CASE WHEN id % 3 <> 0 THEN queue ELSE 'error' END AS correct_queue,
 (CASE WHEN id % 3 <> 0 THEN queue ELSE 'error' END) = queue AS agreed, api_key FROM v_pred WHERE id % 5 = 0"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A training-run log with one run per day of events: accuracy and stage seconds follow the day's rows."""
    n = F.col("n")
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(F.least(F.col("value") / 100, F.lit(1.0))), 4).alias("quality"))
    status = F.when(n % 5 == 0, "failed").when(n % 3 == 0, "rejected").otherwise("promoted")
    return daily.select("day", F.concat(F.lit("v"), F.date_format("day", "yyyyMMdd")).alias("model_version"), status.alias("status"), (0.8 + F.col("quality") / 10).alias("val_accuracy"), n.alias("train_rows"), (n / 10.0).alias("fit_s"), (n / 20.0).alias("embed_s"))


VIEWS["v_runs"] = """SELECT day, 'v' || strftime(day, '%Y%m%d') AS model_version, CASE WHEN n % 5 = 0 THEN 'failed' WHEN n % 3 = 0 THEN 'rejected' ELSE 'promoted' END AS status,
 0.8 + quality / 10 AS val_accuracy, n AS train_rows, n / 10.0::DOUBLE AS fit_s, n / 20.0::DOUBLE AS embed_s
 FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(least(value / 100, 1.0)), 4) AS quality FROM events GROUP BY 1)"""
