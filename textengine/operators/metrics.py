"""Evaluation (EV) on predictions: rows (q_id, y, pred, conf, sim), pred null where none was made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.scratch import materialize

from .similarity import in_bands

CUTS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def right() -> Column:
    return (F.col("pred") == F.col("y")).cast("double")


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.round(F.avg(right()), 4).alias("accuracy"))


def class_counts(df: DataFrame) -> DataFrame:
    """(class, tp, n, predicted) over classes that occur as truth or prediction."""
    y = df.groupBy(F.col("y").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("y")).alias("tp"))
    p = df.where(F.col("pred").isNotNull()).groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("predicted"))
    return y.join(p, "class", "full").na.fill(0, ["n", "tp", "predicted"])


def macro_f1(df: DataFrame) -> DataFrame:
    f1 = 2 * F.col("tp") / (F.col("n") + F.col("predicted"))
    return class_counts(df).agg(F.round(F.avg(f1), 4).alias("macro_f1"), F.count("*").alias("classes"))


def per_class_report(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return class_counts(df).select("class", "n", share("tp", "n").alias("recall"), share("tp", "predicted").alias("precision"), "predicted")


def confusion_pairs(df: DataFrame, n: int) -> DataFrame:
    wrong = df.where(F.col("pred") != F.col("y")).groupBy("y", "pred").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "y", "pred").limit(n)


def threshold_table(df: DataFrame, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """Coverage and accuracy of what is routed at each confidence; one aggregation, all cuts."""
    rows = df.select("y", "pred", "conf", F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("threshold"))
    kept = F.col("conf") >= F.col("threshold")
    share = F.count_if(kept) / F.count("*")
    return rows.groupBy("threshold").agg(F.round(share, 4).alias("coverage"), F.round(F.avg(F.when(kept, right())), 4).alias("accuracy_on_routed"), F.round(1 - share, 4).alias("sent_to_human"))


def ece(df: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; confidence 0 is in none, but counts in the shares."""
    b = F.when(F.col("conf") > 0, F.ceil(F.col("conf") * bins))
    cells = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg(right()).alias("a"))
    total = F.sum("n").over(W.partitionBy())
    part = cells.withColumn("total", total).where(F.col("bin").isNotNull())
    return part.agg(F.round(F.sum(F.col("n") / F.col("total") * F.abs(F.col("c") - F.col("a"))), 4).alias("ece"))


def band_table(df: DataFrame, bands: list[tuple[float, float]], column: str = "sim", predictors: tuple[str, ...] = ("pred",)) -> DataFrame:
    """Per band [lo, hi): n, share of all rows and accuracy of each predictor; empty bands have nulls."""
    edges = df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in bands], "low double, high double")
    cells = in_bands(df, column, bands).groupBy("low").agg(F.count("*").alias("n"), *[F.round(F.avg((F.col(p) == F.col("y")).cast("double")), 4).alias(f"accuracy_{p}") for p in predictors])
    total = df.agg(F.count("*").alias("total"))
    rows = edges.join(cells, "low", "left").crossJoin(F.broadcast(total))
    return rows.select("low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 4).alias("share"), *[f"accuracy_{p}" for p in predictors])


def slice_accuracy(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(f"n_{k}") for k, c in slices.items()], *[F.round(F.avg(F.when(c, right())), 4).alias(f"accuracy_{k}") for k, c in slices.items()])


def true_rank(probs: DataFrame, truth: DataFrame) -> DataFrame:
    """(q_id, r): rank of the true class; no row where it has no probability."""
    r = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc(F.round("p", 9)), "class"))
    ranked = probs.withColumn("r", r).join(truth, "q_id")
    return ranked.where(F.col("class") == F.col("y")).select("q_id", "r", "p")


def topk_hit_rate(probs: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    rows = probs.select("q_id").distinct().join(true_rank(probs, truth), "q_id", "left")
    return rows.agg(*[F.round(F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))), 4).alias(f"top{k}") for k in ks])


def log_loss(probs: DataFrame, truth: DataFrame, eps: float = 1e-6) -> DataFrame:
    q = probs.groupBy("q_id").agg(F.max("p").alias("most"), F.sum(F.col("p") * F.col("p")).alias("squares"))
    rows = q.join(true_rank(probs, truth), "q_id", "left")
    return rows.agg(F.round(F.avg(-F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(eps)))), 4).alias("log_loss"), F.round(F.avg("most"), 4).alias("mean_max"), F.round(F.avg("squares"), 4).alias("mean_squares"))


#: Cells of up to so many rows add up a draw for every row; larger ones take the quantile of their count.
SMALL_CELL = 32


def _uniform(*key: Column) -> Column:
    """Between 0 and 1, from the first 32 bits of md5; other engines draw the same."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *key).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def poisson_edges(most: int = 12) -> list[float]:
    """Distribution function of Poisson(1) at 0, 1, ..."""
    edges, total, p = [], 0.0, math.exp(-1)
    for k in range(most):
        total += p
        edges.append(round(total, 12))
        p /= k + 1
    return edges


def resampled_cells(a: DataFrame, b: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(rep, y, pa, pb, w): n resamples of the rows that a and b share, as counts of the cells (label, prediction
    of a, of b), so a resample costs the number of cells. A cell of m rows is drawn Poisson(m) times: the
    sum of m draws for small m, else the quantile of a uniform number by its normal one and the skewness
    (within one of the exact quantile)."""
    rows = a.select("q_id", F.col("y"), F.col("pred").alias("pa")).join(b.select("q_id", F.col("pred").alias("pb")), "q_id")
    cells = rows.groupBy("y", "pa", "pb").agg(F.count("*").alias("m")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = (F.lit(str(seed)), text("y"), text("pa"), text("pb"), F.col("rep").cast("string"))
    ones = F.transform(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(SMALL_CELL)).cast("int")), lambda i: _uniform(*key, i.cast("string")))
    edges = F.array(*[F.lit(e) for e in poisson_edges()])
    small = F.aggregate(ones, F.lit(0), lambda total, u: total + F.size(F.filter(edges, lambda e: e < u)))
    z = F.sqrt(-2 * F.log(_uniform(*key, F.lit("r")))) * F.cos(F.lit(2 * math.pi) * _uniform(*key, F.lit("a")))
    large = F.floor(F.col("m") + F.sqrt("m") * z + (z * z - 1) / 6 + 0.5)
    w = F.when(F.col("m") <= SMALL_CELL, small.cast("double")).otherwise(F.greatest(large.cast("double"), F.lit(0.0)))
    return cells.select("rep", "y", "pa", "pb", w.alias("w"))


def _interval(gains: DataFrame, measure: str) -> DataFrame:
    low, high = F.round(F.percentile("gain", 0.025), 4), F.round(F.percentile("gain", 0.975), 4)
    verdict = F.when(low > 0, "better").when(high < 0, "worse").otherwise("no difference")
    return gains.agg(F.lit(measure).alias("measure"), F.count("gain").alias("resamples"), F.round(F.avg("gain"), 4).alias("gain"), low.alias("low"), high.alias("high"), verdict.alias("verdict"))


def paired_bootstrap(a: DataFrame, b: DataFrame, n: int = 3000, n_f1: int = 1000, seed: int = 0) -> DataFrame:
    """Gain of b over a in accuracy (n resamples) and in macro-F1 (n_f1) on the same rows, 95 % interval and verdict."""
    cells, _ = materialize(resampled_cells(a, b, max(n, n_f1), seed), "bootstrap-cells")
    hit = lambda p: F.when(F.col(p) == F.col("y"), F.col("w")).otherwise(0.0)
    gains = cells.where(F.col("rep") <= n).groupBy("rep").agg(F.try_divide(F.sum(hit("pb") - hit("pa")), F.sum("w")).alias("gain"))
    none = F.lit(0.0)
    sides = [("y", F.col("w"), none, none, hit("pa"), hit("pb")), ("pa", none, F.col("w"), none, none, none), ("pb", none, none, F.col("w"), none, none)]
    names = ("true", "by_a", "by_b", "hit_a", "hit_b")
    of_class = F.explode(F.array(*[F.struct(F.col(c).alias("class"), *[v.alias(n) for n, v in zip(names, values)]) for c, *values in sides]))
    counts = cells.where(F.col("rep") <= n_f1).select("rep", of_class.alias("s")).where(F.col("s.class").isNotNull()).groupBy("rep", "s.class").agg(*[F.sum(f"s.{c}").alias(c) for c in names])
    # Classes that are neither true nor predicted in a resample don't count in its mean.
    f1 = lambda x: F.try_divide(2 * F.col(f"hit_{x}"), F.col("true") + F.col(f"by_{x}"))
    by_rep = counts.groupBy("rep").agg((F.avg(f1("b")) - F.avg(f1("a"))).alias("gain"))
    return _interval(gains, "accuracy").unionByName(_interval(by_rep, "macro_f1"))


def mean_sd(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("sd"), F.count("*").alias("runs"))


def quantiles(df: DataFrame, value: str, qs: tuple[float, ...]) -> DataFrame:
    return df.agg(*[F.round(F.percentile(value, q), 6).alias(f"q{int(q * 100)}") for q in qs])


def pool_curve(nbrs: DataFrame, truth: DataFrame, place: DataFrame, fracs: tuple[float, ...], familiar: float = 0.5) -> DataFrame:
    """1-NN accuracy and share of familiar queries when only the first part of the pool is there;
    nbrs (q_id, n_id, sim, class), place (n_id, u) the neighbour's place in [0, 1)."""
    rows = nbrs.join(place, "n_id").withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fracs]))).where(F.col("u") < F.col("frac"))
    best = rows.groupBy("frac", "q_id").agg(F.max_by("class", F.struct("sim", (-F.col("n_id")).alias("b"))).alias("pred"), F.max("sim").alias("sim"))
    scored = best.join(truth, "q_id")
    return scored.groupBy("frac").agg(F.count("*").alias("n"), F.round(F.avg(right()), 4).alias("accuracy"), F.round(F.avg((F.col("sim") >= familiar).cast("double")), 4).alias("familiar"))


def neighbour_purity(nbrs: DataFrame, truth: DataFrame) -> DataFrame:
    """P(same class) by rank."""
    rows = nbrs.join(truth, "q_id")
    return rows.groupBy("rank").agg(F.count("*").alias("n"), F.round(F.avg((F.col("class") == F.col("y")).cast("double")), 4).alias("same"))


def chance_rate(df: DataFrame, column: str) -> DataFrame:
    """Chance that two random rows are of one class."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("s", F.col("n") / F.sum("n").over(W.partitionBy())).agg(F.round(F.sum(F.col("s") * F.col("s")), 6).alias("chance"))


def family_fraction(bands: DataFrame, base: float) -> DataFrame:
    """Mixture estimate per band (low, share, same): pi = (same - base) / (1 - base), and the ceiling."""
    pi = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("same") - base) / (1 - base)))
    return bands.withColumn("pi", F.round(pi, 4)).withColumn("ceiling", F.round(F.col("share") * (pi * 0.995 + (1 - pi) * 0.40), 4))


def sibling_report(nbrs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of queries with a neighbour of their class among the k nearest and at rank 1, and 1-NN
    accuracy with and without one."""
    q = nbrs.where(F.col("rank") <= k).join(truth, "q_id").groupBy("q_id").agg(F.bool_or(F.col("class") == F.col("y")).alias("any"), F.bool_or((F.col("class") == F.col("y")) & (F.col("rank") == 1)).alias("first"))
    return q.agg(F.count("*").alias("n"), F.round(F.avg(F.col("any").cast("double")), 4).alias("in_top"), F.round(F.avg(F.col("first").cast("double")), 4).alias("at_first"), F.round(F.avg(F.when(F.col("any"), F.col("first").cast("double"))), 4).alias("accuracy_with"))


def view_oracle(views: list[DataFrame]) -> DataFrame:
    """Agreement of views and accuracy if the best view were known, per (q_id, y, pred)."""
    tall = None
    for v in views:
        tall = v.select("q_id", "y", "pred") if tall is None else tall.unionAll(v.select("q_id", "y", "pred"))
    q = tall.groupBy("q_id").agg(F.bool_or(F.col("pred") == F.col("y")).alias("any"), F.bool_and(F.col("pred") == F.col("y")).alias("all"), (F.min("pred") == F.max("pred")).alias("same"))
    return q.agg(*[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in ("any", "all", "same")])


def segment_report(df: DataFrame, segment: str) -> DataFrame:
    """Accuracy by segment, and overall (segment null) by rollup."""
    return df.rollup(segment).agg(F.count("*").alias("n"), F.round(F.avg(right()), 4).alias("accuracy"))


def label_mix(df: DataFrame, segment: str, label: str) -> DataFrame:
    """(segment, label, share, prior): share within the segment beside the share over all rows."""
    cells = df.groupBy(segment, label).agg(F.count("*").alias("n"))
    own = F.col("n") / F.sum("n").over(W.partitionBy(segment))
    prior = F.sum("n").over(W.partitionBy(label)) / F.sum("n").over(W.partitionBy())
    return cells.select(segment, label, "n", F.round(own, 6).alias("share"), F.round(prior, 6).alias("prior"))


def gain_loss(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows fixed or broken against a reference predictor, with the quartiles of similarity."""
    rows = df.join(reference.select("q_id", F.col("pred").alias("old")), "q_id")
    kind = F.when((F.col("pred") == F.col("y")) & (F.col("old") != F.col("y")), "fixed").when((F.col("pred") != F.col("y")) & (F.col("old") == F.col("y")), "broken").otherwise("same")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), *[F.round(F.percentile("sim", q), 6).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


def exceedance(nbrs: DataFrame, truth: DataFrame, cuts: tuple[float, ...]) -> DataFrame:
    rows = nbrs.where(F.col("rank") == 1).join(truth, "q_id").select("sim", "class", "y", F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut"))
    over = F.col("sim") >= F.col("cut")
    return rows.groupBy("cut").agg(F.count_if(over).alias("n"), F.round(F.avg(F.when(over, (F.col("class") == F.col("y")).cast("double"))), 4).alias("same"))


def embedding_check(a: DataFrame, b: DataFrame) -> DataFrame:
    from textengine.functions.text import dot

    rows = a.select("id", F.col("vec").alias("u")).join(b.select("id", F.col("vec").alias("v")), "id")
    u, v = F.sqrt(dot(F.col("u"), F.col("u"))), F.sqrt(dot(F.col("v"), F.col("v")))
    rows = rows.select((dot(F.col("u"), F.col("v")) / (u * v)).alias("c"), (F.abs(u - 1) < 1e-3).alias("unit"))
    return rows.agg(F.count("*").alias("n"), F.round(F.min("c"), 6).alias("least"), F.round(F.avg("c"), 6).alias("mean"), F.bool_and("unit").alias("unit"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of two probability tables and how often their best classes agree."""
    both = a.select("q_id", "class", F.col("p").alias("pa")).join(b.select("q_id", "class", F.col("p").alias("pb")), ["q_id", "class"], "full").na.fill(0.0, ["pa", "pb"])
    top = both.groupBy("q_id").agg((F.max_by("class", F.struct(F.round("pa", 9), "class")) == F.max_by("class", F.struct(F.round("pb", 9), "class"))).alias("same"), F.max(F.abs(F.col("pa") - F.col("pb"))).alias("d"))
    return top.agg(F.round(F.max("d"), 6).alias("max_diff"), F.round(F.avg(F.col("same").cast("double")), 4).alias("agreement"))


def cross_family_rate(pairs: DataFrame, meta: DataFrame, label: str, same_by: tuple[str, ...], bands: list[tuple[float, float]]) -> DataFrame:
    """Same-class rate of pairs by band, apart for identical and different metadata."""
    a = meta.select(F.col("id").alias("q_id"), F.col(label).alias("la"), F.struct(*same_by).alias("ma"))
    b = meta.select(F.col("id").alias("n_id"), F.col(label).alias("lb"), F.struct(*same_by).alias("mb"))
    rows = in_bands(pairs.join(a, "q_id").join(b, "n_id"), "sim", bands)
    return rows.groupBy("low", F.col("ma").eqNullSafe(F.col("mb")).alias("same_meta")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("la") == F.col("lb")).cast("double")), 4).alias("same"))


def with_missing(df: DataFrame) -> DataFrame:
    """Accuracy where missing predictions count as wrong, their number, and accuracy of the others."""
    return df.agg(F.round(F.avg(F.coalesce(right(), F.lit(0.0))), 4).alias("accuracy"), F.count_if(F.col("pred").isNull()).alias("missing"), F.round(F.avg(right()), 4).alias("accuracy_parsed"))
