"""Operator 3: quality rules and robust multivariate outliers.

Rows that pass the base rules are judged by a vector of transformed statistics. Per language and
source the minimum-covariance-determinant estimate gives the centre and the spread of the
bulk (a share `bulk` of the group); rows whose Mahalanobis distance exceeds `cutoff` standard
deviations are rejected. The cutoff is the usual one, the root of the 97.5 % point of chi-square
with one degree of freedom per statistic. The floors below only shorten distances, so fewer than
2.5 % of normal rows go.

Concentration steps run to convergence from two starts, medians with absolute deviations and
mean with covariance of all, and of both results the one with the least determinant is taken. Each
step is one aggregation: the rows of a group are summed per distance bin, with map-side partial
sums, and the bins nearest the centre that hold the bulk give the next estimate. So every row
counts, no group meets in one task, and quantiles don't depend on the order of rows. A floor on each
spread keeps a statistic that hardly varies from rejecting harmless rows.

The same estimates are made per language and for all rows. A group of n rows has the weight
n / (n + prior_rows) against its language, and a language against all rows, so small groups lean on
their parents and large ones on themselves, without a size at which that changes.

Null texts and texts without words fail the base rules. Null languages and sources form groups of
their own. Repeated rows count as often as they occur, an empty table gives an empty result.
Kept columns whose names clash with the operator's own (the statistics, base_failed, distance,
kept) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import columns, drop_table, materialize
from .stats import NAMES, with_stats

#: Features: name, transformation of the statistics, floor of the standard deviation.
FEATURES = (
    ("length", "ln(1 + n_words)", 0.8),
    ("word_length", "ln(word_chars / greatest(n_words, 1) + 1)", 0.1),
    ("symbols", "ln(1 + 100 * n_symbols / greatest(word_chars, 1))", 0.15),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.1),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", 0.05),
)
P = len(FEATURES)
#: Fixed value: root of 12.8325, the 97.5 % point of chi-square with five degrees of freedom.
CUTOFF = 3.5822
#: Distances are binned at 64 bins for each doubling of the square, values at 256 bins for each unit.
_DISTANCE_BINS, _VALUE_BINS = 64, 256


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_features(df: DataFrame) -> DataFrame:
    return df.withColumns({f"x{i}": F.expr(f"cast({rule} as double)") for i, (_, rule, _) in enumerate(FEATURES)})


def _distance(c: str = "") -> Column:
    """Squared distance from centre m0.. under the inverse w0_0.., both columns of the row."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    return sum((d[i] * d[j] * F.col(f"w{i}_{j}") * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


def _order() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i, P)]


_MODEL = ", ".join([*(f"m{i} double" for i in range(P)), *(f"w{i}_{j} double" for i, j in _order())])
_FLOORS = np.array([f[2] for f in FEATURES]) ** 2


def _start(rows: DataFrame) -> DataFrame:
    """Medians and absolute deviations from them, per group and feature."""

    def median(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy("group", "f", F.floor(F.col("x") * _VALUE_BINS).alias("bin")).count()
        by = W.partitionBy("group", "f").orderBy("bin")
        upto, n = F.sum("count").over(by), F.sum("count").over(W.partitionBy("group", "f"))
        return counts.withColumn("upto", upto).withColumn("n", n).where(2 * F.col("upto") >= F.col("n")).groupBy("group", "f").agg((F.min("bin") / _VALUE_BINS).alias(name))

    tall = rows.select("group", F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("f", "x"))
    middle = median(tall, "mid")
    off = tall.join(middle.select(F.col("group").alias("g2"), F.col("f").alias("f2"), "mid"), (F.col("group") == F.col("g2")) & (F.col("f") == F.col("f2")))
    spread = median(off.select("group", "f", F.abs(F.col("x") - F.col("mid")).alias("x")), "mad")
    wide = middle.join(spread, ["group", "f"]).groupBy("group").agg(
        *[F.max(F.when(F.col("f") == i, F.col("mid"))).alias(f"m{i}") for i in range(P)],
        *[F.max(F.when(F.col("f") == i, F.col("mad"))).alias(f"s{i}") for i in range(P)],
    )
    inverse = [
        (1 / (F.pow(1.4826 * F.col(f"s{i}"), 2) + FEATURES[i][2] ** 2) if i == j else F.lit(0.0)).alias(f"w{i}_{j}")
        for i, j in _order()
    ]
    return wide.select("group", *[f"m{i}" for i in range(P)], *inverse)


def _estimates(near: DataFrame, widen: float) -> DataFrame:
    """From sums over a bulk (group, start, total, n, s*): centre, covariance c* and inverse w* with
    the floors, and the logarithm of the determinant."""
    order = _order()
    names = ["group", "start", "total", *(f"m{i}" for i in range(P)), *(f"c{i}_{j}" for i, j in order), *(f"w{i}_{j}" for i, j in order), "log_det"]
    kinds = ["string", "int", "long", *["double"] * (len(names) - 3)]

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.to_dict("records"):
                centre = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
                spread = np.zeros((P, P))
                for i, j in order:
                    spread[i, j] = spread[j, i] = r[f"s{i}_{j}"] / r["n"] - centre[i] * centre[j]
                spread *= widen
                with_floors = spread + np.diag(_FLOORS)
                inverse = np.linalg.inv(with_floors)
                out.append([r["group"], r["start"], r["total"], *centre, *(spread[i, j] for i, j in order), *(inverse[i, j] for i, j in order), np.linalg.slogdet(with_floors)[1]])
            yield pd.DataFrame(out, columns=names)

    return near.mapInPandas(invert, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def _sums() -> list[Column]:
    one = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    return [F.count("*").alias("n"), *one, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _order()]]


def _concentrate(rows: DataFrame, model: DataFrame, bulk: float) -> DataFrame:
    """One step: centre and spread of the share `bulk` nearest to each model's centre."""
    met = rows.join(model.select(F.col("group").alias("of"), "start", *[c.split()[0] for c in _MODEL.split(", ")]), F.col("group") == F.col("of"))
    bins = met.withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * _DISTANCE_BINS)).groupBy("group", "start", "bin").agg(*_sums())
    one = W.partitionBy("group", "start")
    near = bins.withColumn("upto", F.sum("n").over(one.orderBy("bin"))).withColumn("total", F.sum("n").over(one)).where(F.col("upto") - F.col("n") < F.col("total") * bulk)
    sums = [c for c in bins.columns if c not in ("group", "start", "bin")]
    # The bulk of a normal group spans less than the group: widen by the usual factor.
    return _estimates(near.groupBy("group", "start").agg(F.max("total").alias("total"), *[F.sum(c).alias(c) for c in sums]), _WIDEN)


#: Fixed value: consistency factor of a bulk of 75 % in five dimensions,
#: 0.75 / P(chi-square with 7 degrees <= its 75 % point with 5 degrees).
_WIDEN = 1.41
#: Steps end when no determinant's logarithm falls by more; so many steps at most (a dozen are usual).
_SETTLED, _MOST_STEPS = 1e-3, 40


def least_determinants(rows: DataFrame, bulk: float = 0.75) -> DataFrame:
    """Per group of rows (group, x0..): the settled estimate of least determinant."""
    spark = rows.sparkSession
    whole = _estimates(rows.groupBy("group").agg(*_sums()).withColumn("total", F.col("n")).withColumn("start", F.lit(1)), 1.0)
    columns = ["group", "start", *[c.split()[0] for c in _MODEL.split(", ")]]
    starts = _start(rows).withColumn("start", F.lit(0)).select(columns).unionByName(whole.select(columns))
    model, path = materialize(starts.withColumn("log_det", F.lit(float("inf"))), "mcd-start")
    for _ in range(_MOST_STEPS):
        # A step that doesn't lessen the determinant leaves the estimate as it was.
        step = _concentrate(rows, model, bulk).withColumn("step", F.lit(True))
        both = step.unionByName(model.drop("fell").withColumn("step", F.lit(False)), allowMissingColumns=True)
        one = W.partitionBy("group", "start")
        was = F.max(F.when(~F.col("step"), F.col("log_det"))).over(one)
        fell = both.withColumn("fell", was - F.min("log_det").over(one) > _SETTLED)
        model, fresh = materialize(fell.where(F.col("step") == F.col("fell")).drop("step"), "mcd-step")
        drop_table(spark, path)
        path = fresh
        if not model.agg(F.max("fell")).first()[0]:
            break
    best = W.partitionBy("group").orderBy("log_det", "start")
    found, _ = materialize(model.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "start", "fell"), "mcd-least")
    drop_table(spark, path)
    return found


def fit(stats: DataFrame, bulk: float = 0.75, prior_rows: float = 50.0) -> DataFrame:
    """(lang, source, n, centre m*, inverse w*) of every group with rows that pass the base rules,
    for rows with lang, source and the statistics. Rows that fail the base rules do not count."""
    spark = stats.sparkSession
    slim = with_features(stats.where(~base_failed())).select("lang", "source", *[f"x{i}" for i in range(P)])
    levels = F.array(_level("lang", "source"), _level("lang"), _level())
    rows, path = materialize(slim.select(F.explode(levels).alias("group"), *[f"x{i}" for i in range(P)]), "mcd-rows")
    least = least_determinants(rows, bulk)
    order = _order()
    own = slim.select("lang", "source").distinct()
    values = ["total", *(f"m{i}" for i in range(P)), *(f"c{i}_{j}" for i, j in order)]
    for tag, level in (("g", _level("lang", "source")), ("l", _level("lang")), ("a", _level())):
        named = least.select(F.col("group").alias(f"{tag}_of"), *[F.col(v).alias(f"{tag}_{v}") for v in values])
        own = own.join(named, level == F.col(f"{tag}_of"))
    names = ["lang", "source", "n", *[c.split()[0] for c in _MODEL.split(", ")]]

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.to_dict("records"):
                centre, spread = np.zeros(P), np.zeros((P, P))
                for tag in "alg":
                    # All rows stand for themselves; then each level leans on the one above it.
                    weight = 1.0 if tag == "a" else r[f"{tag}_total"] / (r[f"{tag}_total"] + prior_rows)
                    mine, cov = np.array([r[f"{tag}_m{i}"] for i in range(P)]), np.zeros((P, P))
                    for i, j in order:
                        cov[i, j] = cov[j, i] = r[f"{tag}_c{i}_{j}"]
                    apart = mine - centre
                    spread = weight * cov + (1 - weight) * spread + weight * (1 - weight) * np.outer(apart, apart)
                    centre = weight * mine + (1 - weight) * centre
                inverse = np.linalg.inv(spread + np.diag(_FLOORS))
                out.append([r["lang"], r["source"], r["g_total"], *centre, *(inverse[i, j] for i, j in order)])
            yield pd.DataFrame(out, columns=names)

    kinds = f"lang {stats.schema['lang'].dataType.simpleString()}, source {stats.schema['source'].dataType.simpleString()}, n long, {_MODEL}"
    model, _ = materialize(own.mapInPandas(shrink, kinds), "mcd-model")
    drop_table(spark, path)
    return model


def _level(*columns: str) -> Column:
    """Name of a group; the number of columns tells (en, null) from en as a whole."""
    return F.concat(F.lit(f"{len(columns)}"), *([F.to_json(F.struct(*columns))] if columns else []))


def judge(stats: DataFrame, model: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Add base_failed, distance (Mahalanobis; null without an estimate) and kept."""
    names = [c for c in stats.columns if c not in ("base_failed", "distance", "kept")]
    known = model.withColumnsRenamed({"lang": "__lang", "source": "__source"}).drop("n")
    rows = with_features(stats.select(names))
    found = rows.join(known, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    found = found.withColumn("base_failed", base_failed()).withColumn("distance", F.sqrt(F.greatest(_distance(), F.lit(0.0))))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return found.select(*names, "base_failed", "distance", kept.alias("kept"))


def quality(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, base_failed, distance and kept of every row, beside its columns `keep`.

    The statistics of the fit are written once, without texts; if `keep` holds the text they
    are computed again with it rather than written with it.
    """
    mine = (*NAMES, "base_failed", "distance", "kept")
    keep = tuple(c for c in keep if c not in mine)
    # Kept columns travel under names that no statistic, feature or estimate has.
    under = {c: f"__keep{i}" for i, c in enumerate(keep)}
    rows = df.select("lang", "source", *(c.alias(n) for c, n in zip(columns(text, *keep), ("__body", *under.values()))))
    slim = tuple(n for c, n in under.items() if c != text)
    stats, _ = materialize(with_stats(rows, (*slim, "lang", "source"), "__body"), "mcd-stats")
    whole = with_stats(rows, (*under.values(), "lang", "source"), "__body") if text in keep else stats
    return judge(whole, fit(stats), cutoff).select(*under.values(), *mine).toDF(*keep, *mine)
