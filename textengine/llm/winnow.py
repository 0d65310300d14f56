"""Operator 9 [native]: document fingerprints by winnowing.

A text is cut into tokens: words of up to 16 characters into pieces of up to four from the word's
start, longer runs without blanks (Chinese, Japanese, Thai, long strings) into single characters,
so that the place of a passage in such a run doesn't matter. Each run of `k` tokens is
hashed, and of every `window` neighbouring hashes the least is chosen, the rightmost where
several are equal. Chosen hashes are kept with their positions: two texts that share
window + k - 1 tokens in a row share a fingerprint, and fewer than k shared tokens never count.
At its two ends a shared passage may be cut into other tokens where its first or last run is
longer in one text than in the other.

Everything is a column expression. A text shorter than k tokens has the hash of all its tokens,
a null text counts as empty, and an empty text has an empty fingerprint. Two empty fingerprints
are alike (1), an empty one is unlike any other (0). Memory is about 100 bytes per token of the
one text at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, unused

#: A chosen hash and its place share one long: 36 bits of hash over 28 bits of place, counted
#: down, so that the least value is the least hash at its rightmost place.
_PLACE_BITS = 28
_PLACES = (1 << _PLACE_BITS) - 1
#: Pieces at offsets 0, 4, 8 and 12 of a run of up to 16 characters, else one character.
TOKEN = "|".join([*(rf"(?<=(?<!\S)\S{{{at}}})(?!\S{{{17 - at}}})\S{{1,4}}" for at in (0, 4, 8, 12)), r"\S"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column, k: int = 4, window: int = 10) -> Column:
    """array<long> of the chosen hashes with their places, in order of place."""

    def choose(tokens: Column) -> Column:
        n = F.size(tokens) - (k - 1)
        grams = F.transform(F.sequence(F.lit(0), n - 1), lambda i: packed(F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]), i))
        return F.when(F.size(tokens) == 0, F.array().cast("array<long>")).when(n < 1, F.array(packed(F.xxhash64(F.array_join(tokens, " ")), F.lit(0)))).otherwise(let(grams, minima))

    def packed(value: Column, place: Column) -> Column:
        return F.shiftleft(F.shiftright(value, _PLACE_BITS), _PLACE_BITS).bitwiseOR((F.lit(_PLACES) - place).cast("long"))

    def minima(values: Column) -> Column:
        n = F.size(values) - (window - 1)
        return F.when(n < 1, F.array(F.array_min(values))).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_min(F.slice(values, i, window))))
        )

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), choose)


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, _PLACE_BITS)))


def positions(chosen: Column) -> Column:
    """array<struct<hash, place>> of a fingerprint: place is the token at which the run begins."""
    return F.transform(chosen, lambda v: F.struct(F.shiftright(v, _PLACE_BITS).alias("hash"), (F.lit(_PLACES) - v.bitwiseAND(F.lit(_PLACES))).alias("place")))


def as_text(chosen: Column) -> Column:
    """A fingerprint as hash@place pairs in hexadecimal, separated by blanks."""
    return F.array_join(F.transform(chosen, lambda v: F.concat(F.hex(F.shiftright(v, _PLACE_BITS)), F.lit("@"), F.hex(F.lit(_PLACES) - v.bitwiseAND(F.lit(_PLACES))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    shared = F.size(F.array_intersect(hashes(a), hashes(b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(hashes(a)) + F.size(hashes(b)) - shared))


def with_next(df: DataFrame, key: str, values: dict[str, Column], cell_rows: int = 2000) -> DataFrame:
    """Add `values` to each row, and as next_<name> those of the row that follows in descending
    order of `key`; after the last comes the first. Rows of one key are ordered by their values.

    Rows are ordered in cells, ranges of the key between quantiles (65,536 at most), so that the
    table is exchanged once and no task orders it whole; the first row of each cell is looked
    up for its neighbour. A null key comes last. Rows of one key (null keys are one) share a cell, so
    ids should tell rows apart. Other columns stay, except that `values` and next_<name> replace theirs.
    """
    k, cell_name, of, next_key, first, follows = unused(df, "__key", "__cell", "__of", "__next_key", "__first", "__follows")
    df = df.withColumn(k, F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")))
    side = max(1, min(256, int((df.count() / cell_rows) ** 0.5 + 0.999)))
    n = side * side
    cell = F.lit(0)
    if n > 1:
        cuts = df.agg(F.percentile_approx(k, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
        cuts = sorted(set(cuts))
        groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
        # A cell is found in two steps: the group of cuts, then the place in the group.
        below = lambda cut: cut < F.col(k)
        group = F.size(F.filter(_longs([g[-1] for g in groups]), below))
        cell = group * side + F.size(F.filter(F.get(F.array(*[_longs(g) for g in [*groups, []]]), group), below))
    df = df.withColumn(cell_name, cell.cast("int"))
    tops, _ = materialize(df.groupBy(cell_name).agg(F.max(k).alias(k)), "next-tops")
    along = W.orderBy(F.desc(cell_name))
    everything = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tops = tops.select(F.col(cell_name).alias(of), F.coalesce(F.lead(k).over(along), F.first(k).over(everything)).alias(next_key))
    names, tie = list(values), F.xxhash64(*values)
    firsts = (
        df.join(tops, F.col(k) == F.col(next_key))
        .withColumns(values)
        .groupBy(of)
        .agg(F.min(F.struct(tie.alias("tie"), F.struct(*names).alias("row")))["row"].alias(first))
    )
    inside = W.partitionBy(cell_name).orderBy(F.desc(k), tie)
    return (
        df.withColumns(values)
        .withColumns({follows: F.lead(cell_name).over(inside).isNotNull(), **{f"next_{c}": F.lead(c).over(inside) for c in names}})
        .join(firsts, F.col(cell_name) == F.col(of))
        .withColumns({f"next_{c}": F.when(F.col(follows), F.col(f"next_{c}")).otherwise(F.col(first)[c]) for c in names})
        .drop(k, cell_name, follows, first, of)
    )


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<long>") if values else F.array().cast("array<long>")
