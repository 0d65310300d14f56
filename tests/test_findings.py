"""Findings F45 to F55: work that grew with tokens or with ranges, not with what is asked."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.functions import text as X
from textengine.operators import relational as R
from textengine.plans import registry


def test_a_word_is_cut_into_grams_once(spark, sf):
    """words are counted before they are cut."""
    plan = registry.queries()["pf_12_char_ngrams"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_blanks_collapse_as_before_but_single_blanks_are_not_replaced(spark):
    odd = [" a", "a  b", "a\tb", "a  b", "  　x", "a b", "\x1f", "  ", "", "a\n\n b c"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert not df.where(F.regexp_replace("t", X.WS + "+", " ") != F.regexp_replace("t", X.RUN, " ")).count()
    assert not spark.createDataFrame([("a b c",)], "t string").where(F.col("t").rlike(X.RUN)).count()


def test_word_ngrams_of_three(spark):
    df = spark.createDataFrame([("aa bb cc dd",), ("aa",), ("",)], "t string")
    assert [r[0] for r in df.select(X.word_ngrams("t", 1, 3)).collect()] == [["aa", "bb", "cc", "dd", "aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd"], ["aa"], []]


def test_fractions_over_many_ranges(spark):
    """30 ranges with ties over their borders."""
    df = spark.range(300_000).select("id", F.when(F.col("id") % 9 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)) / 5000).otherwise(1.0).alias("c"))
    found = R.fractions(df, "c", 10).select("id", "pct", F.col("tile").cast("int"))
    want = df.select("id", F.percent_rank().over(W.orderBy("c")).alias("p"), F.ntile(10).over(W.orderBy("c", "id")).alias("t"))
    assert not found.join(want, "id").where("abs(pct - p) > 1e-9 OR tile <> t").count() and found.count() == 300_000
