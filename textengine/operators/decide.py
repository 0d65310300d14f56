"""Decisions from neighbours and probabilities (MD), as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def nn_label(nbrs: DataFrame) -> DataFrame:
    """(q_id, pred, sim): class of the nearest neighbour."""
    return nbrs.where(F.col("rank") == 1).select("q_id", F.col("class").alias("pred"), "sim")


def hybrid(nn: DataFrame, fallback: DataFrame, gate: float = 0.30) -> DataFrame:
    """Nearest neighbour's label from the gate on, else the fallback's (q_id, pred)."""
    rows = fallback.select("q_id", F.col("pred").alias("other")).join(nn, "q_id", "left")
    return rows.select("q_id", F.when(F.col("sim") >= gate, F.col("pred")).otherwise(F.col("other")).alias("pred"))


def decide(probs: DataFrame, threshold: float) -> DataFrame:
    """Per query of (q_id, class, p): pred, confidence, top3 ("class:p" by rank) and auto."""
    p = F.round("p", 4)
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc(F.round("p", 9)), "class"))
    top = probs.withColumn("rank", rank).where(F.col("rank") <= 3)
    three = F.array_sort(F.collect_list(F.struct("rank", F.col("class").alias("queue"), p.alias("p"))))
    rows = top.groupBy("q_id").agg(F.max(F.when(F.col("rank") == 1, F.col("class"))).alias("pred"), F.max(F.when(F.col("rank") == 1, F.col("p"))).alias("confidence"), three.alias("top3"))
    return rows.withColumn("auto", F.col("confidence") >= threshold)


def normalize(scores: DataFrame, score: str = "score") -> DataFrame:
    """Positive scores per (q_id, class) to probabilities."""
    return scores.select("q_id", "class", (F.col(score) / F.sum(score).over(W.partitionBy("q_id"))).alias("p"))


def ensemble(tables: list[DataFrame], classes: DataFrame, how: str = "geometric") -> DataFrame:
    """Geometric or arithmetic mean of probability tables; an absent class counts as 1e-6 or 0."""
    n = len(tables)
    tall = None
    for t in tables:
        tall = t.select("q_id", "class", "p") if tall is None else tall.unionAll(t.select("q_id", "class", "p"))
    rows = tall.select("q_id").distinct().crossJoin(classes).join(tall, ["q_id", "class"], "left").groupBy("q_id", "class")
    if how == "geometric":
        seen, logs = F.count("p"), F.sum(F.when(F.col("p").isNotNull(), F.log(F.greatest("p", F.lit(1e-6)))))
        score = F.exp((F.coalesce(logs, F.lit(0.0)) + (n - seen) * F.log(F.lit(1e-6))) / n)
    else:
        score = F.coalesce(F.sum("p"), F.lit(0.0)) / n
    return normalize(rows.agg(score.alias("score")))


def apply_temperature(probs: DataFrame, temperature: float) -> DataFrame:
    """softmax(log p / T) per query."""
    return normalize(probs.withColumn("score", F.pow(F.greatest("p", F.lit(1e-12)), 1.0 / temperature)))


def fit_temperature(probs: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """(t, log_loss) for each temperature of the grid; truth (q_id, y)."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("t")
    rows = probs.select("q_id", "class", "p", steps).withColumn("s", F.pow(F.greatest("p", F.lit(1e-12)), 1 / F.col("t")))
    rows = rows.withColumn("q", F.col("s") / F.sum("s").over(W.partitionBy("q_id", "t")))
    hit = rows.join(truth, (rows["q_id"] == truth["q_id"]) & (rows["class"] == truth["y"]))
    return hit.groupBy("t").agg(F.avg(-F.log(F.greatest("q", F.lit(1e-12)))).alias("log_loss"))


def select_view(views: dict[str, DataFrame], truth: DataFrame, ks: list[int], powers: list[float]) -> DataFrame:
    """(view, k, power, accuracy) of powered votes, from one table of neighbours per view."""
    tall = None
    for name, nbrs in views.items():
        rows = nbrs.select(F.lit(name).alias("view"), "q_id", "class", "rank", "sim")
        tall = rows if tall is None else tall.unionAll(rows)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("power")) for k in ks for p in powers])
    votes = tall.select("view", "q_id", "class", "rank", "sim", F.inline(cells)).where(F.col("rank") <= F.col("k"))
    votes = votes.groupBy("view", "k", "power", "q_id", "class").agg(F.round(F.sum(F.pow("sim", "power")), 9).alias("v"))
    best = F.row_number().over(W.partitionBy("view", "k", "power", "q_id").orderBy(F.desc("v"), "class"))
    picked = votes.withColumn("n", best).where(F.col("n") == 1).join(truth, "q_id")
    return picked.groupBy("view", "k", "power").agg(F.count("*").alias("n"), F.round(F.avg((F.col("class") == F.col("y")).cast("double")), 4).alias("accuracy"))


def promotion_gate(runs: DataFrame, least: float = 0.85, fall: float = 0.01, forced: bool = False) -> DataFrame:
    """Add bar and promote: accuracy >= max(least, last promoted accuracy - fall) in order of `day`."""
    earlier = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    current = F.last(F.when(F.col("status") == "promoted", F.col("val_accuracy")), ignorenulls=True).over(earlier)
    rows = runs.withColumn("bar", F.greatest(F.lit(least), F.coalesce(current - fall, F.lit(least))))
    return rows.withColumn("promote", (F.col("val_accuracy") >= F.col("bar")) | F.lit(forced))


def fail_safe(decisions: DataFrame, audit: DataFrame) -> DataFrame:
    """auto only where an audit record (id) exists."""
    kept = audit.select("id").distinct().withColumn("__audited", F.lit(True))
    return decisions.join(kept, "id", "left").withColumn("auto", F.col("auto") & F.coalesce("__audited", F.lit(False))).drop("__audited")
