"""Windows, sorts and set operations (WN, SO, SU)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def rank_within(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    w = W.partitionBy(by).orderBy(*order)
    return df.withColumns({"place": F.row_number().over(w), "rank": F.rank().over(w)})


def rate_flags(df: DataFrame, limit: int, seconds: int = 60, wide: dict | None = None) -> DataFrame:
    """Add n (requests of the key in the trailing seconds, this one included), over and
    retry_after: seconds until the oldest of them leaves. wide: keys with a multiple of the limit."""
    t = F.unix_seconds(F.col("created_at").cast("timestamp"))
    w = W.partitionBy("api_key").orderBy(t).rangeBetween(-seconds, 0)
    allowed = F.lit(limit)
    for key, times in (wide or {}).items():
        allowed = F.when(F.col("api_key") == key, limit * times).otherwise(allowed)
    rows = df.withColumns({"n": F.count("*").over(w), "oldest": F.min(t).over(w)})
    over = F.col("n") > allowed
    return rows.withColumns({"over": over, "retry_after": F.when(over, F.col("oldest") + seconds - t + 1)}).drop("oldest")


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def fractions(df: DataFrame, order: str, tiles: int) -> DataFrame:
    """Add pct and tile by global order, from ranges: counts of value ranges first, then places
    within a range, so no task orders the whole table."""
    spark_n = df.count()
    n = max(1, min(4096, spark_n // 10_000))
    cuts = (df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0] or []) if n > 1 else []
    below = lambda found: F.size(F.filter(found, lambda c: c < F.col(order)))
    # Every step-th cut first, then the cuts between two of these.
    step = max(1, math.isqrt(len(cuts)))
    coarse = below(F.array(*[F.lit(c) for c in cuts[step - 1 :: step]])) * step
    cell = coarse + below(F.slice(F.array(*[F.lit(c) for c in cuts]), coarse + 1, step)) if cuts else F.lit(0)
    rows = df.withColumn("__cell", cell.cast("int"))
    sizes = rows.groupBy("__cell").agg(F.count("*").alias("__n"))
    base = sizes.select(F.col("__cell").alias("__c"), (F.sum("__n").over(W.orderBy("__cell")) - F.col("__n")).alias("__base"))
    place = F.row_number().over(W.partitionBy("__cell").orderBy(order, "id")) + F.col("__base")
    first = F.min("__place").over(W.partitionBy("__cell", order))
    rows = rows.join(base, F.col("__cell") == F.col("__c")).withColumn("__place", place)
    big, small = spark_n % tiles, spark_n // tiles
    at = F.col("__place") - 1
    tile = F.when(at < big * (small + 1), F.floor(at / (small + 1))).otherwise(F.lit(big) + F.floor((at - big * (small + 1)) / max(small, 1))) + 1
    return rows.withColumns({"pct": (first - 1) / max(1, spark_n - 1), "tile": tile.cast("int")}).drop("__cell", "__c", "__base", "__place")


def newest(df: DataFrame, n: int, column: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(column), "id").limit(n)


def topk(df: DataFrame, by: str, k: int, order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def union_pools(**pools: DataFrame) -> DataFrame:
    out = None
    for name, df in pools.items():
        rows = df.withColumn("pool", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def overlap(a: DataFrame, b: DataFrame, key: str = "text") -> DataFrame:
    """Counts of distinct texts in both, only in a and only in b."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    both = x.join(y, key, "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
