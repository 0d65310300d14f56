"""Operator 7 [native]: mix sources to target weights with Sainte-Laguë apportionment.

Each source is one stream of words: its documents in a seeded order, cut into blocks of
`block_words`. Targets share all words by weight and stop at `limit` times a source's size.
The mix is a number of equal blocks ("seats"); the highest quotients target / (2 k + 1) win
them, shard by shard, so every shard has integer quotas per source and the sum over the shards
is the apportionment of the whole. A source has at most `limit` seats a block, and what it can't fill goes to the others.

Then a seeded permutation of each source's blocks (swap-or-not shuffle, Hoang, Morris and Rogaway
2012, which permutes any number of blocks by arithmetic) tells which block each seat holds: seat t
holds the block at place t modulo the number of blocks. A shard holds the seats of its quota.

Only DataFrame operations are used. Per document only interval arithmetic is left, because a
prefix sum gives each document its place in the stream; the prefix sums run in cells of about
`cell_rows` documents, so no source, however large, meets in one task. Only tables of one row per
source are ordered as a whole.

Null texts and texts without words have size 0 and nothing is taken from them. A null source is
a source of its own, last in order. Repeated rows are documents of their own, an empty table
gives an empty result, and further columns pass through if `keep` names them; the operator's
own columns are size, source_size, target, taken, shard_taken and copies, and win over columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import WORD_PATTERN, columns, materialize

#: Rounds of the block permutation.
_ROUNDS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """Add weight and target to one row per source (source, source_size).

    A source is held at its limit as long as its limit per weight is at most what the others
    would get per weight; in the order of that ratio these sources come first.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    sources = (
        sources.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
        .withColumn("most", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return sources.withColumn("target", target).select("source", "source_size", "weight", "target", "total")


def quotas(sources: DataFrame, block_words: int, shards: int, limit: float) -> DataFrame:
    """Integer quotas: (source, shard, quota, upto), upto being the sum over the shards so far.

    Seats are won in order of the quotients, so the first seats of a larger mix are the seats of
    a smaller one: shard j gets what seats n j / shards to n (j + 1) / shards add. A source has
    round(share * (1 + e)) seats where e moves all of them by about their number at most, so all but the
    last few seats of a source are settled by its share, and only those compete (a few rows per source).
    """
    n_sources = F.count("*").over(W.partitionBy())
    seats = F.round(F.col("total") / block_words).cast("long")
    grid = (
        sources.where(F.col("target") > 0)
        .withColumn("n_sources", n_sources)
        .withColumn("most", (F.lit(limit) * F.ceil(F.col("source_size") / block_words)).cast("long"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("house", F.floor(seats * (F.col("shard") + 1) / shards).cast("long"))
        .withColumn("share", F.floor(F.col("house") * F.col("target") / F.col("total")).cast("long"))
        .withColumn("slack", F.ceil(2 * F.col("n_sources") * F.col("target") / F.col("total")).cast("long") + 2)
        .withColumn("sure", F.least(F.col("most"), F.greatest(F.lit(0).cast("long"), F.col("share") - F.col("slack"))))
    )
    # One seat more than a source may have stands for sources that are full from the start; it never wins.
    rivals = grid.withColumn("k", F.explode(F.sequence("sure", F.greatest(F.col("sure"), F.least(F.col("most") - 1, F.col("share") + F.col("slack"))))))
    fits = F.col("k") < F.col("most")
    rank = F.row_number().over(W.partitionBy("shard").orderBy(F.desc(fits), F.desc(F.col("target") / (2 * F.col("k") + 1)), F.col("source").asc_nulls_last()))
    won = (
        rivals.withColumn("all_sure", F.sum(F.when(F.col("k") == F.col("sure"), F.col("sure"))).over(W.partitionBy("shard")))
        .withColumn("wins", ((rank <= F.col("house") - F.col("all_sure")) & fits).cast("long"))
        .groupBy("source", "shard")
        .agg((F.first("sure") + F.sum("wins")).alias("upto"))
    )
    before = F.lag("upto").over(W.partitionBy("source").orderBy("shard"))
    return won.withColumn("quota", F.col("upto") - F.coalesce(before, F.lit(0))).select("source", "shard", "quota", "upto")


def permuted(block: Column, keys: Column, blocks: Column) -> Column:
    """Place of a block in the permutation of 0 to blocks - 1 that the keys (one a round) make: each
    round swaps x with its partner key - x, or not, as a hash of the larger of both says."""

    def turn(x: Column, key: Column) -> Column:
        partner = F.pmod(key - x, blocks)
        return F.when(F.xxhash64(F.greatest(x, partner), key).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(keys, block, turn)


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    limit: int = 3,
    block_words: int = 8,
    shards: int = 8,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    cell_rows: int | None = None,
) -> DataFrame:
    """Per row of df the columns `keep`, size, source_size, target, taken, shard_taken and copies.

    taken: words of the document in the mix, repeats counted, at most `limit` times its size;
    shard_taken: how many of them each shard holds (array of `shards` numbers).
    copies: how often the block of its middle word is in the mix, for whole-document mixes.
    """
    mine = ("size", "source_size", "target", "taken", "shard_taken", "copies")
    keep = tuple(c for c in keep if c not in mine)
    base = df.select(
        *[c.alias(f"k{i}") for i, c in enumerate(columns(*keep))],
        *(c.alias(n) for c, n in zip(columns(source, text), ("source", "text"))),
    ).withColumn("place", F.xxhash64(F.lit(seed), "text", *[f"k{i}" for i, c in enumerate(keep) if c != text and isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType, T.StringType))]))
    sources, _ = materialize(base.groupBy("source").agg(F.count("*").alias("n")), "mix-sources")
    if cell_rows is None:
        rows = sources.agg(F.sum("n")).first()[0] or 0
        cell_rows = min(100_000, max(500, rows // 2000))
    sources = sources.withColumn("cells", F.ceil(F.col("n") / cell_rows).cast("long"))

    def placed(columns: list) -> DataFrame:
        return (
            base.withColumn("size", word_count(F.col("text")))
            .select(*columns, "source", "place", "size")
            .join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .withColumn("cell", F.least(F.floor((F.col("place") / 2.0**64 + 0.5) * F.col("cells")), F.col("cells") - 1))
            .drop("of", "n", "cells")
        )

    cells, _ = materialize(placed([]).groupBy("source", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    targets = with_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, limit)
    won = quotas(targets, block_words, shards, limit).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("won"))  # one entry per shard
    rounds = F.transform(F.sequence(F.lit(1), F.lit(_ROUNDS)), lambda r: F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), r), "blocks"))
    targets, _ = materialize(
        targets.join(won.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
        .withColumn("upto", F.coalesce(F.col("won.upto"), F.array_repeat(F.lit(0).cast("long"), shards)))
        .withColumn("keys", rounds)
        .select("source", "source_size", "target", "blocks", "upto", "keys"),
        "mix-targets",
    )
    ids = [f"k{i}" for i in range(len(keep))]
    in_cell = W.partitionBy("source", "cell").orderBy("place", "size", *[f"k{i}" for i, c in enumerate(keep) if c != text and isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType, T.StringType))])
    spot = (
        placed(ids)
        .withColumn("sized", F.sum("size").over(in_cell.rowsBetween(W.unboundedPreceding, 0)))
        .join(cells.select(F.col("source").alias("s1"), F.col("cell").alias("c1"), "base"), F.col("source").eqNullSafe(F.col("s1")) & (F.col("cell") == F.col("c1")))
        .join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
        .withColumn("start", F.col("base") + F.col("sized") - F.col("size"))
        .withColumn("end", F.col("base") + F.col("sized"))
    )

    place = lambda block: permuted(block, F.col("keys"), F.col("blocks"))

    def copies(upto: Column, place: Column) -> Column:
        """Seats below upto that hold the block at this place."""
        return F.when(upto > place, F.floor((upto - place - 1) / F.col("blocks")) + 1).otherwise(F.lit(0)).cast("long")

    def part(block: Column) -> Column:
        inside = F.least(F.col("end"), (block + 1) * block_words) - F.greatest(F.col("start"), block * block_words)
        return F.struct(inside.alias("words"), place(block).alias("place"))

    def upto_shard(parts: Column) -> Column:
        return F.transform("upto", lambda upto: F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total + x["words"] * copies(upto, x["place"])))

    first, last = F.expr(f"start div {block_words}"), F.expr(f"(end - 1) div {block_words}")
    middle = F.expr(f"(start + size div 2) div {block_words}")
    has = F.col("size") > 0
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    # Parts are made once per row: the lambda's variable stands for their array.
    sums = F.when(has, F.get(F.transform(F.array(F.transform(F.sequence(first, last), part)), upto_shard), F.lit(0))).otherwise(none)
    whole = F.element_at("upto", -1)
    rows = spot.select(
        *ids,
        "size",
        "source_size",
        "target",
        sums.alias("sums"),
        F.when(has, copies(whole, place(middle))).otherwise(F.lit(0)).cast("long").alias("copies"),
    )
    by_shard = F.transform("sums", lambda v, i: v - F.when(i > 0, F.get("sums", i - 1)).otherwise(F.lit(0)))
    # Kept columns take their names last: one may be named like a column that is read here.
    found = rows.select(*ids, "size", "source_size", "target", F.element_at("sums", -1), by_shard, "copies")
    return found.toDF(*keep, *mine)
