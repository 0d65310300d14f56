"""Filters, checks and per-row decisions (FL, parts of PF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.functions import text as X


def route_language(df: DataFrame, text: str = "text") -> DataFrame:
    """Add share (English sentences, 3 places) and language: de if more than half are not English."""
    s = X.sentences(F.col(text))
    df = df.withColumn("__flags", F.transform(s, X.is_english))
    n, e = F.size("__flags"), F.size(F.filter("__flags", lambda x: x))
    share = F.when(n > 0, F.round(e / n, 3)).otherwise(F.lit(0.0))
    return df.withColumns({"share": share, "language": F.when(2 * (n - e) > n, "de").otherwise("en")}).drop("__flags")


def chunk_sentences(df: DataFrame, sentence: str, budget: int) -> DataFrame:
    """Add pieces: sentences over `budget` words are cut after commas and packed greedily."""
    n_words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    parts = F.split(F.col(sentence), r"(?<=,)\s+")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def pack(acc: Column, part: Column) -> Column:
        longer = F.trim(F.concat(acc["now"], F.lit(" "), part))
        over = (acc["now"] != "") & (n_words(longer) > budget)
        return F.struct(F.when(over, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(over, part).otherwise(longer).alias("now"))

    packed = F.aggregate(parts, start, pack, lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))
    return df.withColumn("pieces", F.when(n_words(F.col(sentence)) > budget, packed).otherwise(F.array(sentence)))


def pack_in_order(df: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """(by, bins): rows of each key folded in order into bins, a new one whenever the next row would
    lift a bin over the budget. Bins are sizes in order; a key's rows have to fit one array."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("n")))).alias("rows"))

    def fold(bins: Column, row: Column) -> Column:
        last = F.get(bins, F.size(bins) - 1)
        fits = (F.size(bins) > 0) & (last + row["n"] <= budget)
        return F.when(fits, F.concat(F.slice(bins, F.lit(1), F.size(bins) - 1), F.array(last + row["n"]))).otherwise(F.array_append(bins, row["n"]))

    return rows.select(by, F.aggregate("rows", F.array().cast("array<bigint>"), fold).alias("bins"))


def collect_tags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("tags", F.array_compact(F.array(*columns)))


def meta_doc(df: DataFrame) -> DataFrame:
    """Add doc: type, priority and tags (comma lists cut apart) as tokens."""
    tags = F.filter(F.flatten(F.transform("tags", lambda t: F.split(t, ","))), lambda t: F.trim(t) != "")
    tokens = F.transform(tags, lambda t: F.concat(F.lit("tag="), F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("_"))))
    head = [F.concat(F.lit(f"{n}="), F.lower(F.coalesce(F.col(c).cast("string"), F.lit("none")))) for n, c in (("type", "type"), ("prio", "priority"))]
    return df.withColumn("doc", F.array_join(F.concat(F.array(*head), tokens), " "))


def prefix_contained(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(a_id, b_id) where the first n characters of a's text occur in b's text.

    A prefix is looked up by its rarest whole word among b's words, one without a whole word (fewer
    than three words) by its first characters, eight at most, among b's runs of as many. The index
    is built of the words and runs that prefixes ask for only and holds ids, not texts; each text is joined
    once with the prefixes that it may contain. An empty prefix is contained in every text and is left out.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    heads = a.select(F.col("id").alias("a_id"), F.substring("text", 1, n).alias("head")).where(F.col("head") != "")
    # Whole words of the prefix: neither its first nor its last one may be cut.
    inner = F.slice(words(F.col("head")), F.lit(2), F.greatest(F.size(words(F.col("head"))) - 2, F.lit(0)))
    asked = heads.select("a_id", F.explode(inner).alias("w"))
    found = b.select(F.col("id").alias("b_id"), F.explode(F.array_distinct(words(F.col("text")))).alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    df_of = found.groupBy("w").agg(F.count("*").alias("df"))
    best = asked.join(df_of, "w", "left").groupBy("a_id").agg(F.min_by("w", F.struct(F.coalesce("df", F.lit(0)), "w")).alias("w"))
    maybe = best.join(found, "w").select("a_id", "b_id")
    short = heads.where(F.size(inner) == 0).select("a_id", F.left("head", F.lit(8)).alias("w"))
    for size in [r[0] for r in short.select(F.length("w")).distinct().collect()]:  # eight lengths at most
        keys = short.where(F.length("w") == size)
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - size + 1, F.lit(1))), lambda i: F.substr(F.col("text"), i, F.lit(size))))
        grams = b.select(F.col("id").alias("b_id"), F.explode(runs).alias("w")).join(keys.select("w").distinct(), "w", "left_semi")
        maybe = maybe.union(keys.join(grams, "w").select("a_id", "b_id"))
    rows = maybe.join(heads, "a_id").join(b.select(F.col("id").alias("b_id"), F.col("text").alias("b_text")), "b_id")
    return rows.where(F.contains("b_text", "head")).select("a_id", "b_id")


def encode_labels(df: DataFrame, column: str) -> DataFrame:
    """Add label: place of the name among the sorted distinct names, from 0."""
    names = df.select(column).distinct().where(F.col(column).isNotNull())
    names = names.withColumn("label", F.dense_rank().over(W.orderBy(column)) - 1)
    return df.join(names, column, "left")


def filter_pool(df: DataFrame, language: str, queues: list[str]) -> DataFrame:
    return df.where((F.col("language") == language) & F.col("queue").isin(queues) & (F.col("text") != ""))


def length_between(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def recent(df: DataFrame, days: int, as_of: Column | None = None, column: str = "created_at") -> DataFrame:
    """Rows of the last `days` (held within 1 to 90) before as_of, by default the latest row."""
    days = max(1, min(90, days))
    if as_of is not None:
        return df.where(F.col(column) >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    last = df.agg(F.max(column).alias("__last"))
    return df.join(F.broadcast(last), F.col(column) >= F.col("__last") - F.expr(f"INTERVAL {days} DAYS")).drop("__last")


def served_version(df: DataFrame, version: str) -> DataFrame:
    return df.where(F.col("version") == version)


def exclude_keys(df: DataFrame, keys: list, column: str = "api_key") -> DataFrame:
    return df.where(~F.col(column).isin(keys))


def validate(df: DataFrame, most_subject: int = 300, most_body: int = 8000, languages: tuple[str, ...] = ("auto", "en", "de")) -> DataFrame:
    """Add reasons (codes) and ok."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reasons = F.array_compact(
        F.array(
            F.when(blank("subject") & blank("body"), "empty"),
            F.when(F.length("subject") > most_subject, "subject_too_long"),
            F.when(F.length("body") > most_body, "body_too_long"),
            F.when(~F.col("language").isin(*languages), "language"),
        )
    )
    return df.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)


def judge_filter(df: DataFrame, judged: DataFrame, column: str) -> DataFrame:
    """Rows whose label a judge (id, pred) agrees with."""
    return df.join(judged, "id").where(F.col("pred") == F.col(column)).drop("pred")
