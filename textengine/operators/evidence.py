"""Evidence per query and class (AG), from neighbour lists (q_id, rank, n_id, sim, class)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PLACES = 6


def with_class(nbrs: DataFrame, labels: DataFrame, column: str = "queue") -> DataFrame:
    return nbrs.join(labels.select(F.col("id").alias("n_id"), F.col(column).alias("class")), "n_id")


def grid(nbrs: DataFrame, classes: DataFrame) -> DataFrame:
    """Every query with every class (class); the class list is a small dimension."""
    return nbrs.select("q_id").distinct().crossJoin(classes.select("class").distinct())


def per_class(nbrs: DataFrame, classes: DataFrame, floor: float = 0.0) -> DataFrame:
    """(q_id, class, best, cnt): best similarity and number of neighbours per class. A class
    without all neighbours never falls below `floor`, since the others' slots count as floor."""
    of_query = nbrs.groupBy("q_id").agg(F.count("*").alias("k"))
    found = nbrs.groupBy("q_id", "class").agg(F.max("sim").alias("top"), F.count("*").alias("cnt"))
    rows = grid(nbrs, classes).join(found, ["q_id", "class"], "left").join(of_query, "q_id")
    best = F.when(F.col("cnt") == F.col("k"), F.col("top")).otherwise(F.greatest(F.coalesce("top", F.lit(float(floor))), F.lit(float(floor))))
    return rows.select("q_id", "class", best.alias("best"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def channels(parts: dict[str, tuple[DataFrame, float]], classes: DataFrame) -> DataFrame:
    """Wide evidence: best_<channel> and cnt_<channel> per query and class; a channel that has no
    neighbours for a query counts as its floor. parts: channel -> (neighbours, floor)."""
    tall = None
    for name, (nbrs, floor) in parts.items():
        rows = per_class(nbrs, classes, floor).withColumn("channel", F.lit(name))
        tall = rows if tall is None else tall.unionByName(rows)
    wide = tall.groupBy("q_id", "class").agg(
        *[F.max(F.when(F.col("channel") == n, F.col("best"))).alias(f"best_{n}") for n in parts], *[F.max(F.when(F.col("channel") == n, F.col("cnt"))).alias(f"cnt_{n}") for n in parts]
    )
    fill = {f"best_{n}": F.coalesce(f"best_{n}", F.lit(float(floor))) for n, (_, floor) in parts.items()}
    return wide.withColumns(fill | {f"cnt_{n}": F.coalesce(f"cnt_{n}", F.lit(0)) for n in parts})


def gap(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Add the margin over the best other row of the group; all rows that tie for first have 0."""
    best_two = F.slice(F.sort_array(F.collect_list(value).over(W.partitionBy(by)), asc=False), 1, 2)
    first, second = F.get(best_two, F.lit(0)), F.get(best_two, F.lit(1))
    return df.withColumn(name, F.col(value) - F.when(F.col(value) >= first, F.coalesce(second, first)).otherwise(first))


def pair_rows(wide: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the stacker: best, cnt, gap and top of each channel, and the class's index."""
    for n in names:
        wide = gap(wide, "q_id", f"best_{n}", f"gap_{n}").withColumn(f"top_{n}", F.max(f"best_{n}").over(W.partitionBy("q_id")))
    index = F.dense_rank().over(W.partitionBy("q_id").orderBy("class")) - 1
    return wide.withColumn("class_id", index)


def class_feats(nbrs: DataFrame, best: DataFrame, classes: DataFrame, k: int = 10) -> DataFrame:
    """Per query and class: best over the whole pool (-1 if the class has none), gap, rank-weighted vote among
    the k nearest and share of the five nearest; s1, s5 and top1 of the query. nbrs: the k nearest or more (5 at
    least), with rank; best (q_id, class, best): every class's nearest row, however far down the list."""
    near = nbrs.groupBy("q_id", "class").agg(F.sum(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)).alias("vote"), (F.count_if(F.col("rank") <= 5) / 5).alias("cnt5"))
    own = nbrs.groupBy("q_id").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(n) for r, c, n in ((1, "sim", "s1"), (5, "sim", "s5"), (1, "class", "top1"))])
    total = sum(1.0 / r for r in range(1, k + 1))
    rows = grid(nbrs, classes).join(best, ["q_id", "class"], "left").join(near, ["q_id", "class"], "left")
    rows = rows.select("q_id", "class", F.coalesce("best", F.lit(-1.0)).alias("best"), (F.coalesce("vote", F.lit(0.0)) / total).alias("vote"), F.coalesce("cnt5", F.lit(0.0)).alias("cnt5"))
    return gap(rows, "q_id", "best", "gap").join(own, "q_id")


def knn_vote(nbrs: DataFrame, k: int, power: float, floor: float = 0.0) -> DataFrame:
    """(q_id, class, p): powers of similarity above the floor, normalized per query."""
    v = nbrs.where(F.col("rank") <= k).groupBy("q_id", "class").agg(F.sum(F.pow(F.greatest(F.col("sim") - floor, F.lit(0.0)), power)).alias("v"))
    return v.select("q_id", "class", (F.col("v") / F.greatest(F.sum("v").over(W.partitionBy("q_id")), F.lit(1e-12))).alias("p"))


def knn_softvote(nbrs: DataFrame, k: int, temperature: float) -> DataFrame:
    near = nbrs.where(F.col("rank") <= k)
    e = F.exp((F.col("sim") - F.max("sim").over(W.partitionBy("q_id"))) / temperature)
    v = near.withColumn("e", e).groupBy("q_id", "class").agg(F.sum("e").alias("v"))
    return v.select("q_id", "class", (F.col("v") / F.sum("v").over(W.partitionBy("q_id"))).alias("p"))


def agreement(views: dict[str, DataFrame]) -> DataFrame:
    """(q_id, class, votes): how many views' nearest neighbour is of the class."""
    first = None
    for nbrs in views.values():
        rows = nbrs.where(F.col("rank") == 1).select("q_id", "class")
        first = rows if first is None else first.unionAll(rows)
    return first.groupBy("q_id", "class").agg(F.count("*").alias("votes"))


def purity(nbrs: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, purity): share of the k nearest that are of the nearest one's class."""
    near = nbrs.where(F.col("rank") <= k).withColumn("first", F.first("class").over(W.partitionBy("q_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return near.groupBy("q_id").agg(F.avg((F.col("class") == F.col("first")).cast("double")).alias("purity"))


def noisy_or(pairs: DataFrame, p: str) -> DataFrame:
    """(q_id, class, noisy_or, most) of the neighbours' probabilities, held below 0.999."""
    q = F.least(F.col(p), F.lit(0.999))
    return pairs.groupBy("q_id", "class").agg((1 - F.exp(F.sum(F.log1p(-q)))).alias("noisy_or"), F.max(p).alias("most"))


def per_source_class(nbrs: DataFrame, source: str) -> DataFrame:
    return nbrs.groupBy("q_id", source, "class").agg(F.max("sim").alias("best"))


def context_feats(nbrs: DataFrame, words: DataFrame) -> DataFrame:
    """Per query: s1, s2, s5, mean of ten, best similarity of another class than the first's, margin, words (id, n_words)."""
    first = F.first("class").over(W.partitionBy("q_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = nbrs.withColumn("first", first)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("sim")))
    out = rows.groupBy("q_id").agg(
        at(1).alias("s1"), at(2).alias("s2"), at(5).alias("s5"), F.avg(F.when(F.col("rank") <= 10, F.col("sim"))).alias("mean10"), F.coalesce(F.max(F.when(F.col("class") != F.col("first"), F.col("sim"))), F.lit(0.0)).alias("rival")
    )
    return out.withColumn("margin", F.col("s1") - F.col("rival")).join(words.withColumnRenamed("id", "q_id"), "q_id", "left")


def class_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add the number of classes with a strictly larger value."""
    return rows.withColumn(name, F.rank().over(W.partitionBy("q_id").orderBy(F.desc(value))) - 1)


def class_prior(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    return counts.select("class", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("prior"))


def centroids(vectors: DataFrame, families: DataFrame) -> DataFrame:
    """(id, term, w) of families: normalized sums of the members' vectors; families (id, family)."""
    sums = vectors.join(families, "id").groupBy(F.col("family").alias("id"), "term").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return sums.select("id", "term", (F.col("w") / norm).alias("w"))


def nearest_similarity(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(q_id, familiarity): the best similarity over classes and channels."""
    most = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    return wide.groupBy("q_id").agg(F.max(most).alias("familiarity"))
