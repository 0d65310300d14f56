import os

from pyspark.sql import functions as F

from textengine.operators import chunks as C
from textengine.operators import similarity as J
from textengine.operators import vectorize as V


def corpus(spark, n=60):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (F.col("id") % 7 + 3).cast("int")), lambda i: F.concat(F.lit("wort"), (i * F.col("id") % 11).cast("string"))))
    rows = spark.range(n).select(F.col("id"), text.alias("text"))
    odd = spark.createDataFrame([(3, "wort1 wort1 once"), (90, None), (91, ""), (92, "a b c"), (None, "wort2 wort3"), (None, "wort3 wort4")], "id long, text string")
    return rows.union(odd)


def rounded(df):
    return sorted((str(r[0]), r[1], round(r[2], 9)) for r in df.collect())


def by_rows(df, **kinds):
    terms = V.token_rows(df)
    return V.transform_tfidf(terms, V.fit_tfidf(terms, V.count_rows(df)), **kinds)


def test_chunks_weigh_as_rows_do(spark):
    df = corpus(spark)
    for kinds in ({}, {"binary": True}, {"sublinear": False}):
        assert rounded(V.tfidf_view(df, **kinds)) == rounded(by_rows(df, **kinds))
    small = C.term_chunks(df, postings=20)
    assert small.count() > 10 and rounded(C.weights(small, small)) == rounded(by_rows(df))


def test_a_chunk_asks_once_for_each_term(spark):
    """What is shuffled are the terms of chunks, not the terms of texts."""
    df = corpus(spark, 4000).coalesce(1)
    found = C.term_chunks(df)
    asked = C.known_terms(found, found).agg(F.sum(F.size("places"))).first()[0]
    assert asked * 100 < V.tfidf_view(df).count()


def test_fitted_on_other_rows(spark):
    df = corpus(spark)
    fit, other = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    terms = V.token_rows(fit)
    want = V.transform_tfidf(V.token_rows(other), V.fit_tfidf(terms, V.count_rows(fit)))
    a, b = C.term_chunks(other, postings=30), C.term_chunks(fit, postings=30)
    assert rounded(C.weights(a, b)) == rounded(want)
    pairs = lambda q, p: sorted(map(tuple, J.sparse_topk(q, p, 3).select("q_id", "n_id", "sim", "rank").collect()))
    rows = pairs(want, by_rows(fit))
    assert rows and pairs(C.weights(a, b, form="queries"), C.weights(b, b, form="pool")) == rows
    assert pairs(C.weights(a, b, form="lists"), C.weights(b, b, form="lists")) == rows


def test_nothing_to_weigh(spark):
    df = corpus(spark).where("id > 89")
    assert V.tfidf_view(df).count() == 0
    assert J.sparse_topk(*[V.tfidf_view(df.where("id = 7"), form=f) for f in ("queries", "pool")], 3).count() == 0


def test_a_search_holds_small_batches(spark, monkeypatch):
    """Blocks go through Python a few at a time; the session's own setting stays."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    w = by_rows(corpus(spark).where("id < 60"))
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(int(spark.conf.get(key))), write(self, *a, **b))[1])
    assert J.sparse_topk(w, w, 3, same=True).count() and seen and max(seen) <= 8 << 20
    assert spark.conf.get(key) == before


def test_blocks_and_chunks_are_stored_in_few_bytes(spark):
    """A search's blocks and chunks stay far below 8 bytes a posting, and the chunks go when the blocks are written."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(120)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), 40 * i).cast("string"))))
    chunks = C.term_chunks(spark.range(3000).select("id", text.alias("text")).coalesce(1))
    postings = C.weights(chunks, chunks).count()
    stored = chunks.select(F.length("at") + F.length("tf")).first()[0]
    folder = chunks.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    q, p = C.search_sides(chunks, chunks)
    assert stored < 3 * postings and not os.path.exists(folder)
    for blocks in (q, p):
        assert blocks.select(F.length("at") + F.length("w") + F.length("norm")).first()[0] < 3 * postings


def test_pairs_and_groups_by_blocks(spark):
    """neither classes nor given pairs send a text's vector through a join."""
    df = corpus(spark).where("id < 60")
    w, chunks = by_rows(df), C.term_chunks(df, postings=30)
    q, p = C.search_sides(chunks, chunks)
    pairs = w.select(F.col("id").alias("q_id")).distinct().crossJoin(w.select(F.col("id").alias("n_id")).distinct()).where("(q_id + n_id) % 3 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(J.dots(pairs, q, p)) == rows(J.pair_dot(pairs, w, w).select("q_id", "n_id", F.round("sim", 6)))
    labels = df.select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("class"))
    best = J.best_per_class(q, p, labels)
    assert rows(best) == rows(J.best_per_class(w, w, labels))
    assert not any(r[0] for r in best.select(F.col("class").isNull()).distinct().collect())
