"""Searches block against block: what they put out grows with the queries, not with the pool's parts."""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.operators import blocks as B
from textengine.operators import similarity as J


@contextmanager
def small_splits(spark):
    """Every file is read in a task of its own."""
    keys = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1k"}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def vectors(spark, n=240, common=6, rare=60):
    """Unit vectors (id, term, w): some terms that nearly all rows have, some that few have."""
    draw = random.Random(3)
    rows = [(i, f"t{t}", draw.random() + 0.1) for i in range(n) for t in {*range(common), *(draw.randrange(common, common + rare) for _ in range(6))}]
    df = spark.createDataFrame(rows, "id long, term string, w double")
    return df.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id"))))


def plain(w):
    return J.sparse_pairs(w, w).where("q_id <> n_id").withColumn("sim", F.round("sim", 6))


def rows_of(df):
    return sorted((r["q_id"], r["n_id"], r["sim"]) for r in df.collect())


def test_a_search_puts_out_the_best_of_all_blocks_of_its_part(spark):
    w = vectors(spark).repartition(24, "id").cache()
    with small_splits(spark):
        found = B.similar(w, w, 4, same="apart", postings=90).cache()
        assert found.count() <= 240 * 4 * B.TASKS
        assert rows_of(J.top_k(found, 4)) == rows_of(J.top_k(plain(w), 4))


def test_groups_put_out_one_value_for_each_part_not_for_each_block(spark):
    w = vectors(spark).repartition(24, "id").cache()
    groups = w.select("id").distinct().withColumn("group", F.col("id") % 5)
    with small_splits(spark):
        found = B.similar(w, w.join(groups, "id"), postings=90).cache()
        assert found.count() <= 240 * 5 * B.TASKS
        best = found.groupBy("q_id", "n_id").agg(F.max("sim").alias("sim"))
        want = J.sparse_pairs(w, w).withColumn("sim", F.round("sim", 6)).groupBy("q_id", (F.col("n_id") % 5).alias("n_id")).agg(F.max("sim").alias("sim"))
        assert rows_of(best) == rows_of(want)


def test_results_held_are_cut_and_groups_beyond_them_leave_early(spark, monkeypatch):
    w = vectors(spark)
    parts = {}
    for name, index in (("q", False), ("p", True)):
        parts[name] = [r.asDict() for r in B.packed(w, index, 300).collect()]
    wide = {}
    for held in (40, 1 << 18):
        monkeypatch.setattr(B, "HELD", held)
        best, most = {}, 0
        for q in parts["q"]:
            mine = B._Queries(q, None, -1e-6)
            out = [b for p in parts["p"] for b in mine.add(p, None, True)]
            most = max(most, mine.held)
            for b in [*out, *mine.best()]:
                for r in b.to_pylist():
                    best[r["q_id"], r["n_id"]] = max(best.get((r["q_id"], r["n_id"]), 0.0), r["sim"])
        wide[held] = best
        assert most <= held
    assert wide[40] == wide[1 << 18]


def test_links_join_what_all_pairs_join_with_a_pair_for_each_row(spark):
    from textengine.operators import chunks as C
    from textengine.operators import families as M

    draw = random.Random(5)
    words = [f"wort{i}" for i in range(40)]
    texts = [" ".join(draw.choices(words, k=4)) for _ in range(6)]
    docs = spark.createDataFrame([(i, texts[draw.randrange(6)] + f" {words[i % 40]}", ["en", "de", None][i % 3]) for i in range(200)], "id long, text string, language string").repartition(6, "id")
    rows = C.term_chunks(docs, by=F.coalesce(F.concat(F.lit("in "), "language"), F.lit("none")), postings=60)
    assert rows.groupBy("chunk").agg(F.countDistinct("by").alias("n")).where("n <> 1").isEmpty()
    found = B.links(C.weights(rows, rows, form="queries", kept=F.col("by") != "none"), 0.6)
    w = C.weights(rows, rows)
    lang = docs.select("id", "language")
    pairs = plain(w).where("sim >= 0.6 AND q_id < n_id").join(lang.toDF("q_id", "a"), "q_id").join(lang.toDF("n_id", "b"), "n_id").where("a = b")
    out = lambda e: sorted(map(tuple, M.families(e, docs).collect()))
    assert out(found) == out(pairs)
    assert found.count() < pairs.count() / 2


def test_dense_searches_hold_few_queries_at_a_time(spark, monkeypatch):
    from textengine.operators import ivf as I

    draw = random.Random(8)
    v = spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(150)], "id long, vec array<double>").cache()
    found = lambda: (sorted(map(tuple, I.exact_topk(v, v, 3, same=True, cells=4)[0].collect())), sorted(map(tuple, I.search(v, v, 3).collect())))
    want = found()
    monkeypatch.setattr(I, "QUERY_ROWS", 40)
    monkeypatch.setattr(I, "SLICE", 7)
    assert I.query_blocks(v) == 4
    assert found() == want
