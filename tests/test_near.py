"""Findings of round 4: a set that is joined with itself or searched by itself, block against block."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from test_search import plain, rows_of, small_splits, vectors
from textengine.operators import blocks as B
from textengine.operators import chunks as C
from textengine.operators import similarity as J


def corpus(spark, n=300):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (F.col("id") % 9 + 4).cast("int")), lambda i: F.concat(F.lit("wort"), F.pmod(F.xxhash64("id", i), 7 * i + 3).cast("string"))))
    return spark.range(n).select("id", text.alias("text")).repartition(5, "id")


def test_two_blocks_meet_once(spark):
    """A join of a set with itself met all pairs of blocks twice, or sent all postings through a join."""
    w = vectors(spark).repartition(12, "id").cache()
    with small_splits(spark):
        blocks = B.written(w, True, 90)
        n = blocks.count()
        met = B._met_once(blocks).select(F.least("block", "p_block"), F.greatest("block", "p_block"))
        assert n > 10 and met.count() == met.distinct().count() == n * (n + 1) // 2
        for low in (0.05, 0.3, 0.6, 0.9):
            want = rows_of(plain(w).where(f"q_id < n_id AND sim >= {low}"))
            assert rows_of(B.pairs_within(blocks, low)) == want == rows_of(J.sim_join(w, w, low, 2.0, same=True))


def test_a_join_of_merged_blocks(spark):
    """The blocks of chunks, merged, give what the rows of TF-IDF give."""
    df = corpus(spark)
    chunks = C.term_chunks(df, postings=60)
    small, rows = chunks.count(), C.weights(chunks, chunks).cache()
    want = rows_of(plain(rows).where("q_id < n_id AND sim >= 0.3"))
    blocks = C.own_blocks(chunks)
    assert len(want) > 50 and blocks.count() < small / 3
    assert rows_of(J.sim_join(blocks, blocks, 0.3, 2.0, same=True)) == want
    assert rows_of(J.loo_topk(blocks, 4)) == rows_of(J.top_k(plain(rows), 4))


def test_single_precision_only_tells_which_pairs_count(spark):
    """Weights that single precision can't hold, and similarities that differ beyond its digits."""
    w = vectors(spark, 60)
    tiny = w.withColumn("w", F.when(F.col("id") % 3 > 0, F.col("w") * F.pow(F.lit(10.0), -50.0)).otherwise(F.col("w")))
    for rows in (w, tiny):
        assert rows_of(J.loo_topk(rows, 5)) == rows_of(J.top_k(plain(rows), 5))
    close = spark.range(400).select("id", F.explode(F.array(*[F.struct(F.lit(f"t{i}").alias("term"), (0.1 + F.pmod(F.xxhash64("id", F.lit(i)), 50) * 1e-7).alias("w")) for i in range(40)])).alias("t")).select("id", "t.term", "t.w")
    assert rows_of(J.loo_topk(close, 3)) == rows_of(J.top_k(plain(close), 3))


def test_dense_searches_copy_no_vectors(spark):
    """A vector was shuffled once for each block of the other side."""
    v = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.pmod(F.xxhash64("id", i), 9) / 4 - 1).alias("vec")).cache()
    found = J.dense_topk(v, v, 3, same=True, rows_per_block=60)
    assert "explode" not in found._jdf.queryExecution().toString()
    unit = v.select("id", F.posexplode("vec").alias("i", "x"), F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).select("id", F.col("i").alias("term"), (F.col("x") / F.col("n")).alias("w"))
    assert rows_of(found) == rows_of(J.top_k(plain(unit), 3))
    folds = J.dense_topk(v, v, 3, apart=F.col("id") % 3, rows_per_block=60)
    assert rows_of(folds) == rows_of(J.top_k(plain(unit).where("(q_id - n_id) % 3 <> 0"), 3))


def test_stacker_rows_are_searched_for_once(spark, sf):
    """each fit and each prediction searched again."""
    from textengine.plans import models as P

    files = P.stacker_rows(spark, sf).inputFiles()
    assert files and all("/stacker-" in f for f in files)


def test_columns_of_an_ablation_are_made_once(spark):
    """six fits and six predictions each made the columns from the texts again, in several passes."""
    from textengine.operators import models as M

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def column(x):
        made.add(1)
        return float(x % 7)

    df = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("label"), column("id").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    got = M.block_ablation(df, {"one": ["a"], "both": ["a", "b"]})
    assert sorted(r["n"] for r in got.collect()) == [200, 200] and made.value <= 400


def test_a_search_within_a_set_meets_two_blocks_once_for_both(spark):
    """Each two blocks met twice, and every task put out a row for each result."""
    w = vectors(spark).repartition(24, "id").cache()
    want = plain(w)
    with small_splits(spark):
        blocks = B.written(w, True, 90)
        for k in (1, 4, 300):
            found = J.loo_topk(blocks, k)
            assert rows_of(found) == rows_of(J.top_k(want, k))
            assert not found.join(J.top_k(want, k).withColumnRenamed("rank", "r"), ["q_id", "n_id"]).where("r <> rank").count()
