"""Corpus-level text features (TX) on long tables (id, term, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.functions import text as X
from textengine.operators import chunks as C


def token_rows(df: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(id, term, tf) of rows (id, text)."""
    tokens = X.tokens(F.col("text")) if tokens is None else tokens
    return df.select("id", F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def fit_vocab(terms: DataFrame, min_df: int = 2, max_df: float | None = None, cap: int | None = None) -> DataFrame:
    """(term, df, cf) with min_df <= df <= max_df (a share of documents), the `cap` most frequent."""
    vocab = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    if max_df is not None:
        n = terms.select("id").distinct().agg((F.count("*") * max_df).alias("most"))
        vocab = vocab.join(F.broadcast(n), F.col("df") <= F.col("most")).drop("most")
    return vocab.orderBy(F.desc("cf"), "term").limit(cap) if cap else vocab


def fit_tfidf(terms: DataFrame, n_docs: DataFrame, min_df: int = 2) -> DataFrame:
    """(term, idf): ln((1 + N) / (1 + df)) + 1; n_docs has one row with column n."""
    vocab = fit_vocab(terms, min_df).join(F.broadcast(n_docs))
    return vocab.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def transform_tfidf(terms: DataFrame, idf: DataFrame, sublinear: bool = True, binary: bool = False) -> DataFrame:
    """(id, term, w): tf times idf with L2-normalized rows; terms outside the vocabulary go."""
    tf = F.lit(1.0) if binary else 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = terms.join(idf, "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("w"))


def tfidf_view(df: DataFrame, tokens: Column | None = None, min_df: int = 2, sublinear: bool = True, binary: bool = False, form: str = "rows") -> DataFrame:
    """Fit and transform in one go, by chunks of texts."""
    found = C.term_chunks(df, tokens)
    return C.weights(found, found, min_df, sublinear, binary, form)


def rare_tokens(df: DataFrame, low: int = 2, high: int = 30) -> DataFrame:
    """(id, rare): sorted tokens that `low` to `high` documents hold."""
    terms = df.select("id", F.explode(F.array_distinct(X.tokens(F.col("text"), X.RARE))).alias("term"))
    kept = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(low, high))
    return terms.join(kept.select("term"), "term").groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("rare"))


def bm25_weights(terms: DataFrame, n_docs: DataFrame, k1: float = 1.2, b: float = 0.75, min_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """((id, term, w) of the documents, (term, idf))."""
    vocab = fit_vocab(terms, min_df).join(F.broadcast(n_docs))
    idf = vocab.select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    known = terms.join(idf, "term")
    size = known.groupBy("id").agg(F.sum("tf").alias("size"))
    # Documents without a known term count in the mean length too.
    mean = size.agg(F.sum("size").alias("all")).join(n_docs).select((F.col("all") / F.col("n")).alias("mean"))
    rows = known.join(size, "id").join(F.broadcast(mean))
    w = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean"))) * F.col("idf")
    return rows.select("id", "term", w.alias("w")), idf


def bm25_sides(queries: DataFrame, pool: DataFrame, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Queries (id, text) and pool as rows (id, term, w) whose products add up to the score, divided by the query's bound."""
    weights, idf = bm25_weights(token_rows(pool), count_rows(pool), k1, b)
    asked = token_rows(queries).join(idf, "term").select("id", "term", "idf")
    bound = asked.groupBy("id").agg((F.sum("idf") * (k1 + 1)).alias("bound"))
    return asked.join(bound, "id").select("id", "term", (1 / F.greatest("bound", F.lit(1e-6))).alias("w")), weights


def onehot(df: DataFrame, token_column: str) -> DataFrame:
    """Distinct (id, token) rows of a token string."""
    return df.select("id", F.explode(F.split(token_column, " ")).alias("token")).where(F.col("token") != "").distinct()


def oov_rate(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, oov): share of white-space words that the vocabulary (term) lacks; 0 without words."""
    w = df.select("id", F.explode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("term"))
    seen = w.join(vocab.select("term", F.lit(1).alias("known")), "term", "left")
    rates = seen.groupBy("id").agg(F.avg(F.when(F.col("known").isNull(), 1.0).otherwise(0.0)).alias("oov"))
    return df.select("id").join(rates, "id", "left").select("id", F.coalesce("oov", F.lit(0.0)).alias("oov"))


def conjunctions(weights: DataFrame, order: int = 2, min_df: int = 2, max_terms: int = 30) -> DataFrame:
    """(id, term, w): products of the `max_terms` heaviest terms' weights for each pair (order 2)
    or triple (order 3), kept if `min_df` documents hold them, L2-normalized."""
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("w", 9)), "term"))
    top = weights.withColumn("place", place).where(F.col("place") <= max_terms)
    top = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t"))
    one = top.select("id", "t", F.posexplode("t").alias("i", "a"))
    two = one.select("id", "t", "a", F.posexplode("t").alias("j", "b"), "i").where(F.col("j") > F.col("i"))
    rows = two.select("id", "t", "j", F.concat("a.term", F.lit("&"), "b.term").alias("term"), (F.col("a.w") * F.col("b.w")).alias("w"))
    if order == 3:
        three = rows.select("id", "term", "w", "j", F.posexplode("t").alias("k", "c")).where(F.col("k") > F.col("j"))
        rows = three.select("id", F.concat("term", F.lit("&"), "c.term").alias("term"), (F.col("w") * F.col("c.w")).alias("w"))
    df_of = rows.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).select("term")
    kept = rows.select("id", "term", "w").join(df_of, "term")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return kept.select("id", "term", (F.col("w") / norm).alias("w"))


def hash_features(rows: DataFrame, buckets: int) -> DataFrame:
    """(id, bucket, w): terms hashed into buckets by the first 32 bits of their md5, each with the sign of the next four."""
    digest = F.md5(F.col("term").cast("binary"))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")
    sign = F.when(F.substring(digest, 9, 1) < "8", 1.0).otherwise(-1.0)
    return rows.groupBy("id", bucket.alias("bucket")).agg(F.sum(F.col("w") * sign).alias("w"))


def contrast_keywords(df: DataFrame, flag: str, most: int = 12, least: int = 3) -> DataFrame:
    """(term, ratio) of distinct keyword tokens, by how much more often flagged rows hold them."""
    n = df.agg(F.count_if(flag).alias("n1"), F.count_if(~F.col(flag)).alias("n0"))
    t = df.select(flag, F.explode(F.array_distinct(X.keyword_tokens(F.col("text")))).alias("term"))
    c = t.groupBy("term").agg(F.count_if(flag).alias("c1"), F.count_if(~F.col(flag)).alias("c0")).where(F.col("c1") >= least)
    ratio = ((F.col("c1") + 1) / (F.col("n1") + 2)) / ((F.col("c0") + 1) / (F.col("n0") + 2))
    return c.join(F.broadcast(n)).select("term", "c1", F.round(ratio, 6).alias("ratio")).orderBy(F.desc("ratio"), "term").limit(most)


def family_weights(df: DataFrame, family: str = "family") -> DataFrame:
    n = F.count("*").over(W.partitionBy(family))
    return df.withColumn("size", n).withColumns({"w_inverse": 1 / n, "w_sqrt": 1 / F.sqrt(n), "w_single": F.when(n == 1, 3.0).otherwise(1.0)})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (C n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    both = W.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(both) / (F.count("*").over(both) * F.col("n")))


def encode_sequences(df: DataFrame, size: int, length: int) -> DataFrame:
    """(id, position, token_id): the `size` most frequent words get ids from 2, others 1; the first
    `length` positions of each text, padded with 0."""
    w = df.select("id", F.posexplode(X.tokens(F.col("text"))).alias("position", "term"))
    counts = w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    vocab = counts.withColumn("token_id", F.row_number().over(W.orderBy(F.desc("n"), "term")) + 1).select("term", "token_id")
    coded = w.where(F.col("position") < length).join(F.broadcast(vocab), "term", "left").select("id", "position", F.coalesce("token_id", F.lit(1)).alias("token_id"))
    grid = df.select("id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("position"))
    return grid.join(coded, ["id", "position"], "left").select("id", "position", F.coalesce("token_id", F.lit(0)).alias("token_id"))
