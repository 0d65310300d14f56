"""Properties of operators that SQL can't compare, and cases with known results."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textengine.functions import text as X
from textengine.operators import decide as D
from textengine.operators import evidence as E
from textengine.operators import families, metrics, monitor, split
from textengine.operators import ivf as I
from textengine.operators import models as M
from textengine.operators import similarity as J
from textengine.operators import vectorize as V
from textengine.scratch import materialize


def test_greedy_dedup_follows_row_order(spark):
    rng = np.random.default_rng(0)
    pairs = sorted({tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(90)})
    dropped = set()
    for i in range(60):
        if i not in dropped:
            dropped |= {b for a, b in pairs if a == i}
    rows = spark.range(60)
    got = {r["id"] for r in split.greedy_dedup(rows, spark.createDataFrame(pairs, "q_id long, n_id long")).collect()}
    assert got == set(range(60)) - dropped


def test_registered_greedy_dedup_keeps_what_is_no_near_copy(spark, sf):
    import __spark_entry__ as entry
    from textengine.plans import neighbours, rows

    w = neighbours.all_w(spark, sf)
    near = {tuple(sorted((r["q_id"], r["n_id"]))) for r in J.sim_join(w, w, 0.85, 2.0, same=True).collect()}
    dropped = set()
    for a, b in sorted(near):
        if a not in dropped:
            dropped.add(b)
    every = {r["id"] for r in rows.docs(spark, sf).select("id").collect()}
    assert {r["id"] for r in entry.queries()["dd_03_greedy_dedup"](spark, sf).collect()} == every - dropped


def test_families_are_components_in_any_order(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21)]
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9, 20, 21, 30)], "id long")
    for e in (edges, edges[::-1]):
        got = {r["id"]: (r["family"], r["size"]) for r in families.families(spark.createDataFrame(e, "q_id long, n_id long"), nodes).collect()}
        assert got == {**{i: (1, 6) for i in (1, 2, 3, 7, 8, 9)}, 20: (20, 2), 21: (20, 2), 30: (30, 1)}


def test_splits_are_disjoint_and_stratified(spark):
    df = spark.range(100).withColumn("queue", F.when(F.col("id") < 30, "a").otherwise("b"))
    rows = split.stratified_split(df, "queue", 0.2, 42).groupBy("queue", "split").count().collect()
    assert {(r["queue"], r["split"]): r["count"] for r in rows} == {("a", "test"): 6, ("a", "train"): 24, ("b", "test"): 14, ("b", "train"): 56}
    folds = split.assign_folds(df, "queue", 5, 1).groupBy("queue", "fold").count()
    assert folds.groupBy("queue").agg((F.max("count") - F.min("count")).alias("d")).agg(F.max("d")).first()[0] <= 1


def test_floor_is_a_clamp(spark):
    nbrs = spark.createDataFrame([(1, 0.1, "a"), (1, 0.9, "b"), (2, 0.1, "a"), (2, 0.2, "a")], "q_id long, sim double, class string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "class string")
    got = {(r["q_id"], r["class"]): (r["best"], r["cnt"]) for r in E.per_class(nbrs, classes, 0.5).collect()}
    assert got == {(1, "a"): (0.5, 1), (1, "b"): (0.9, 1), (1, "c"): (0.5, 0), (2, "a"): (0.2, 2), (2, "b"): (0.5, 0), (2, "c"): (0.5, 0)}


def test_ties_for_the_best_have_gap_zero(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.5)], "q_id long, class string, v double")
    assert {r["class"]: round(r["g"], 6) for r in E.gap(rows, "q_id", "v", "g").collect()} == {"a": 0.0, "b": 0.0, "c": -0.4}


def test_sim_join_is_exact(spark):
    rng = np.random.default_rng(1)
    vocab = [f"t{i}" for i in range(40)]
    rows = spark.createDataFrame([(i, " ".join(rng.choice(vocab, 12))) for i in range(60)], "id long, text string")
    w = V.tfidf_view(rows)
    want = {(r["q_id"], r["n_id"]) for r in J.sparse_pairs(w, w).where("q_id < n_id AND round(sim, 6) >= 0.4").collect()}
    assert {(r["q_id"], r["n_id"]) for r in J.sim_join(w, w, 0.4, same=True).collect()} == want


def recall_and_share(q, v, k=10):
    index = I.build(v, k)
    exact = J.dense_topk(q, v, k, same=True).select("q_id", "n_id")
    found = I.search(q, v, k, index=index).select("q_id", "n_id")
    share = I.compared(q, index).first()
    return exact.join(found, ["q_id", "n_id"]).count() / exact.count(), share["compared"] / share["pairs"]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_approximate_neighbours_recall(spark, size):
    """The query as registered, against all other rows. The vectors of these tables point anywhere (no
    direction has more variance than another), so cells exclude few rows."""
    from textengine.plans import neighbours

    recall, share = recall_and_share(*neighbours.search(spark, f"/root/testdata/{size}"))
    assert recall >= 0.9 and share < 0.8


def test_inverted_file_compares_few_rows_of_clustered_vectors(spark):
    rng, shares = np.random.default_rng(5), []
    for n in (600, 2400):
        centres = rng.normal(size=(n // 20, 32))
        vectors = centres[rng.integers(len(centres), size=n)] + 0.4 * rng.normal(size=(n, 32))
        v = spark.createDataFrame([(i, x) for i, x in enumerate(vectors.tolist())] + [(n, None), (n + 1, [0.0] * 32)], "id long, vec array<double>")
        recall, share = recall_and_share(v.where("id % 20 = 0 and vec is not null"), v.where("vec is not null"))
        shares.append(share)
        assert recall >= 0.9 and share <= 0.2
    assert shares[1] < shares[0]


def test_exact_dense_topk_leaves_out_cells(spark, sf):
    rng, n = np.random.default_rng(6), 1500
    centres = rng.normal(size=(20, 24))
    vectors = (centres[rng.integers(20, size=n)] + 0.25 * rng.normal(size=(n, 24))).tolist()
    v = spark.createDataFrame([*enumerate(vectors), (n, vectors[0]), (n + 1, None), (n + 2, [0.0] * 24)], "id long, vec array<double>")
    q, kept = v.where("id % 20 = 0"), v.where("vec is not null")
    found, visited = I.exact_topk(q, v, 7, same=True, cells=40)
    want = J.dense_topk(q.where("vec is not null"), kept, 7, same=True)
    assert {(r["q_id"], r["n_id"], r["sim"], r["rank"]) for r in found.collect()} == {(r["q_id"], r["n_id"], r["sim"], r["rank"]) for r in want.collect()}
    share = visited.first()
    assert 0 < share["visited"] < 0.25 * share["cells"]
    assert I.exact_topk(q, v.where("false"), 7)[0].count() == 0 == I.exact_topk(q.where("false"), v, 7)[0].count()


def test_dense_topk_in_blocks_meets_every_row(spark):
    """Both sides in several blocks, and partitions that stay apart: every block must meet every other one."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(400, 8))
    v = spark.createDataFrame([*enumerate(vectors.tolist())], "id long, vec array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit[::4] @ unit.T, 6)
    sims[np.arange(100), np.arange(0, 400, 4)] = -2
    want = {(4 * i, int(j), r + 1) for i, row in enumerate(sims) for r, j in enumerate(np.lexsort((np.arange(400), -row))[:5])}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = J.dense_topk(v.where("id % 4 = 0"), v, 5, same=True, rows_per_block=70).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["q_id"], r["n_id"], r["rank"]) for r in found} == want


def test_bounded_topk_equals_the_plain_join(spark):
    rng = np.random.default_rng(2)
    rare = lambda i: " ".join(f"r{x}" for x in rng.choice(900, 6)) + f" only{i}"
    rows = spark.createDataFrame([(i, f"the {rare(i)}" + " of" * int(i % 3)) for i in range(1000)] + [(2000, "the"), (2001, "the of")], "id long, text string")
    w, _ = materialize(V.tfidf_view(rows, min_df=1), "w")
    plain = J.sparse_pairs(w, w).where("q_id <> n_id")
    assert {tuple(r) for r in J.top_k(plain, 5).collect()} == {tuple(r) for r in J.bounded_topk(w, w, 5, same=True).collect()}
    marks = J.bounded_marks(w, w, 5, same=True)
    assert plain.count() > 0.9 * 1002**2 and J.bounded_pairs(marks, w, same=True).count() < 0.05 * 1002**2
    sides = V.bm25_sides(rows.where("id < 40 or id >= 2000"), rows)
    scores = J.sparse_pairs(*sides)
    assert {tuple(r) for r in J.top_k(scores, 5).collect()} == {tuple(r) for r in J.bounded_topk(*sides, 5, unit=False).collect()}
    bounds = J.bounded_marks(*sides, 5, unit=False).groupBy("q_id").agg(F.max("upto").alias("bound"))
    assert scores.join(bounds, "q_id").where("sim > bound + 1e-9").count() == 0


def test_blocks_equal_the_plain_join_without_its_rows(spark):
    """Searches and joins in many blocks; nothing is shuffled in proportion to the pairs that share a term."""
    from textengine.operators import blocks as B

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(3 * i, "the " + " ".join(f"r{x}" for x in rng.choice(200, 6))) for i in range(600)] + [(5000, "the")], "id long, text string").repartition(3)
    w, _ = materialize(V.tfidf_view(rows, min_df=1), "w")
    plain = J.sparse_pairs(w, w)
    as_set = lambda df: {tuple(r) for r in df.select("q_id", "n_id", "sim").collect()}
    apart = plain.where("q_id <> n_id")
    assert as_set(J.top_k(B.similar(w, w, 5, same="apart", postings=700), 5)) == as_set(J.top_k(apart, 5))
    assert B.similar(w, w, 5, same="apart", postings=700).count() < 0.1 * apart.count()
    want = as_set(plain.where("q_id < n_id").withColumn("sim", F.round("sim", 6)).where("sim >= 0.2 and sim < 0.5"))
    assert as_set(B.similar(w, w, low=0.2, same="less", postings=700).where("sim < 0.5")) == want == as_set(J.sim_join(w, w, 0.2, 0.5, same=True))
    pairs = spark.createDataFrame([(0, 3), (0, 3), (0, 5000), (6, 7), (9, 9)], "q_id long, n_id long")
    dots = {(r["q_id"], r["n_id"]): r["sim"] for r in plain.collect()}
    found = J.pair_dot(pairs, w, w).collect()
    assert len(found) == 5 and all(abs(r["sim"] - dots.get((r["q_id"], r["n_id"]), 0.0)) < 1e-12 for r in found)
    assert "MapInArrow" in J.pair_dot(pairs, w, w)._jdf.queryExecution().toString()


def test_bounded_topk_with_few_neighbours_and_one_hot_term(spark):
    q = spark.createDataFrame([(1, "a", 1.0), (2, "hot", 1.0), (3, "b", 0.6), (3, "hot", 0.8), (4, "none", 1.0)], "id long, term string, w double")
    p = spark.createDataFrame([(i, "hot", 1.0 - i / 500) for i in range(100, 400)] + [(500, "a", 1.0), (501, "b", 0.9)], "id long, term string, w double")
    want = {tuple(r) for r in J.top_k(J.sparse_pairs(q, p), 3).collect()}
    assert {tuple(r) for r in J.bounded_topk(q, p, 3).collect()} == want and len(want) == 7
    assert J.bounded_pairs(J.bounded_marks(q, p, 3), p).count() < 20
    assert J.bounded_topk(q.where("false"), p, 3).count() == 0 == J.bounded_topk(q, p.where("false"), 3).count()


def test_class_evidence_of_the_whole_pool_equals_the_plain_join(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, "the " + " ".join(f"r{x}" for x in rng.choice(700, 6)) + f" of own{i % 5}") for i in range(900)] + [(2000, "the"), (2001, "alone")], "id long, text string")
    labels = rows.select("id", F.when(F.col("id") < 2000, F.concat(F.lit("c"), F.col("id") % 7)).alias("class"))
    w, _ = materialize(V.tfidf_view(rows, min_df=1), "w")
    q, p = w.where("id % 9 = 0 or id >= 2000"), w.where("id % 9 <> 0")
    sims = J.sparse_pairs(q, p).join(labels.withColumnRenamed("id", "n_id"), "n_id").where("class is not null")
    want = {tuple(r) for r in sims.groupBy("q_id", "class").agg(F.round(F.max("sim"), 6).alias("best")).collect()}
    assert {tuple(r) for r in J.best_per_class(q, p, labels).collect()} == want and len(want) > 600
    # Every query shares a term with every row; few of these pairs are joined.
    asked, pool = J.class_sides(q, p, labels)
    met = J.bounded_pairs(J.bounded_marks(asked, pool, 1), pool).count()
    assert met < 0.2 * sims.count()
    assert J.best_per_class(q.where("false"), p, labels).count() == 0 == J.best_per_class(q, p, labels.where("false")).count()
    near = J.sparse_topk(q, p.where("id < 2000"), 10).join(labels.withColumnRenamed("id", "n_id"), "n_id")
    found = {(r["q_id"], r["class"]): r for r in E.class_feats(near, J.best_per_class(q, p, labels), labels.where("class is not null").select("class").distinct()).collect()}
    ranked = {(r["q_id"], r["rank"]): r for r in near.collect()}
    for (q_id, name), r in found.items():
        mine = [k for k in range(1, 11) if (q_id, k) in ranked and ranked[q_id, k]["class"] == name]
        assert abs(r["vote"] - sum(1 / k for k in mine) / sum(1 / k for k in range(1, 11))) < 1e-9
        assert r["cnt5"] == sum(k <= 5 for k in mine) / 5 and r["s1"] == ranked[q_id, 1]["sim"] and r["top1"] == ranked[q_id, 1]["class"]


def test_places_in_hash_order(spark):
    """Cells of the hash give the same places as one sort, per class (also null) and over all rows."""
    from textengine.operators import split as P

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "ab"[i % 2]) for i in range(400)], "id long, queue string")
    for by in ("queue", None):
        got = P.placed(rows, by, 3).collect()
        want = {}
        for r in sorted(rows.collect(), key=lambda r: (hashlib.md5(f"{r['id']}-3".encode()).hexdigest(), r["id"])):
            want.setdefault(r["queue"] if by else 0, []).append(r["id"])
        for r in got:
            ids = want[r["queue"] if by else 0]
            assert ids[r["__p"] - 1] == r["id"] and r["__nc"] == len(ids)


def test_short_prefixes_are_found(spark):
    from textengine.operators import quality as Q

    a = spark.createDataFrame([(1, "ab cd"), (2, "x"), (3, "one two three four"), (4, ""), (5, "zz"), (6, None)], "id long, text string")
    b = spark.createDataFrame([(10, "xab cdy"), (11, "none"), (12, "say one two three four"), (13, "az"), (14, None), (15, "")], "id long, text string")
    assert {tuple(r) for r in Q.prefix_contained(a, b, 40).collect()} == {(1, 10), (2, 10), (3, 12)}


def test_whole_texts_are_cleaned(spark):
    long = "word " * 1000 + "end"
    got = spark.createDataFrame([(long,)], "t string").select(X.clean(F.lit(""), F.col("t")).alias("all"), X.clean(F.lit(""), F.col("t"), 2000).alias("cut")).first()
    assert got["all"].endswith("end") and len(got["cut"]) == 2000


def test_probabilities_sum_to_one(spark):
    nbrs = spark.createDataFrame([(q, r, 1.0 / r, c) for q in range(5) for r, c in enumerate("abcab", 1)], "q_id long, rank int, sim double, class string")
    for p in (E.knn_vote(nbrs, 5, 2), E.knn_softvote(nbrs, 5, 0.1), D.apply_temperature(E.knn_vote(nbrs, 5, 2), 2.0)):
        assert all(abs(r["s"] - 1) < 1e-9 for r in p.groupBy("q_id").agg(F.sum("p").alias("s")).collect())


def predictions(spark, n, queues="a", nearest=0.5, confidence=0.85):
    return spark.range(n).select(F.element_at(F.array(*[F.lit(q) for q in queues]), (F.col("id") % len(queues) + 1).cast("int")).alias("queue"), F.lit(nearest).alias("nearest"), F.lit(confidence).alias("confidence"))


def test_drift(spark):
    ref = predictions(spark, 1000, "aaabbccccc")
    fb = lambda n, agreed: spark.range(n).select((F.col("id") % 10 < agreed).alias("agreed"))
    status = lambda live, f, r=ref: monitor.drift_report(live, f, r).first()
    none = fb(0, 0)
    assert status(ref, none)["status"] == "ok" and status(ref, none)["psi"] == 0
    got = status(predictions(spark, 1000, "aaabbccccc", nearest=0.2), none)
    assert got["status"] == "drift" and got["reasons"] == ["unfamiliar"]
    assert status(predictions(spark, 1000, "abcccccccc"), none)["psi"] >= 0.2
    assert status(ref, fb(100, 7))["status"] == "drift" and status(ref, fb(100, 7))["live_accuracy"] == 0.7
    assert status(predictions(spark, 10), none)["status"] == "insufficient_data" and status(ref, none, None)["status"] == "unknown"


def test_ece_bins_are_open_to_the_left(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.0), (2, 1, 1, 1.0), (3, 1, 0, 0.2)], "q_id long, y int, pred int, conf double")
    assert metrics.ece(rows).first()[0] == round(0.2 / 3, 4)


def test_shuffled_labels_keep_their_counts(spark):
    df = spark.range(50).withColumn("queue", (F.col("id") % 3).cast("string"))
    got = split.shuffle_labels(df, "queue", 1)
    assert got.groupBy("shuffled").count().orderBy("shuffled").collect() == df.groupBy(F.col("queue").alias("shuffled")).count().orderBy("shuffled").collect()


def test_lcs(spark):
    df = spark.createDataFrame([("a b c d", "b x d a"), ("", ""), ("a", None)], "a string, b string")
    assert [round(r["ratio"], 3) for r in M.lcs_ratio(df, "a", "b").collect()] == [0.5, 0.0, 0.0]


def test_throttle_admits_the_limit(spark, tmp_path):
    from textengine.streaming import jobs

    rows = spark.range(5).select("id", F.lit(1).cast("long").alias("api_key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10).alias("created_at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_to_end(jobs.throttle(stream, 3), "throttle-test").orderBy("id").collect()
    assert [r["admitted"] for r in got] == [True, True, True, False, False]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(sql) > 140


def test_truncated_svd_equals_numpy(spark, sf):
    from textengine.operators import lsa
    from textengine.plans import vectors

    w, _ = materialize(V.tfidf_view(vectors.docs(spark, sf), min_df=5), "w")
    rows = w.toPandas()
    wide = rows.pivot(index="id", columns="term", values="w").fillna(0.0)
    u, s, _ = np.linalg.svd(wide.to_numpy(), full_matrices=False)
    values, found = lsa.truncated_svd(w, 40, rows_per_block=60)
    # The values fall slowly here, so the last of 40 are the least exact.
    error = np.abs(np.array(values) / s[:40] - 1)
    assert error[:6].max() < 0.01 and error.max() < 0.1
    got = {r["id"]: r["v"] for r in found.collect()}
    ours, want = np.stack([got[i] for i in wide.index]), u[:, :6] * s[:6]
    # Leading directions up to signs: inner products of rows agree.
    assert np.abs(ours[:, :6] @ ours[:, :6].T - want @ want.T).max() < 0.02
    assert lsa.truncated_svd(w.where("false"), 5)[0] == []
    whole = np.array(lsa.truncated_svd(w, 400)[0])  # more than there are rows
    assert len(whole) == (s > 1e-6 * s[0]).sum() and np.abs(whole / s[: len(whole)] - 1).max() < 0.01


def test_lcs_by_bits(spark):
    import random

    from textengine.operators import models as M

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(300):
        x, y = ([rng.choice("abcdefg") for _ in range(rng.randrange(150))] for _ in range(2))
        assert M.lcs_length(x, y) == plain(x, y)
    df = spark.createDataFrame([("a b", "c d"), ("a b c", "a b"), (None, "a"), ("a x", "a y")], "a string, b string")
    assert [r["ratio"] for r in M.lcs_ratio(df, "a", "b").collect()] == [0.0, 0.8, 0.0, 0.5]
    assert [r["ratio"] for r in M.lcs_ratio(df, "a", "b", least=0.6).collect()] == [None, 0.8, None, None]


def test_registered_lcs_equals_a_plain_version(spark, sf):
    import __spark_entry__ as entry

    from textengine.plans import views

    texts = {r["id"]: (r["text"] or "").split() for r in views.cleaned(spark, sf).collect()}
    rows = entry.queries()["ud_04_lcs_ratio"](spark, sf).collect()
    assert rows
    for r in rows[:: max(1, len(rows) // 40)]:
        x, y = texts[r["q_id"]], texts[r["n_id"]]
        codes = {w: i for i, w in enumerate({*x, *y})}
        right, row = np.array([codes[w] for w in y]), np.zeros(len(y) + 1, int)
        for w in x:
            step = row.copy()
            step[1:] = np.maximum(row[1:], (row[:-1] + 1) * (right == codes[w]))
            row = np.maximum.accumulate(step)
        assert abs(r["ratio"] - 2 * int(row[-1]) / max(1, len(x) + len(y))) < 1e-6


def test_prototypes_equal_plain_kmeans_per_class(spark):
    from textengine.operators import models as M

    rng = np.random.default_rng(3)
    rows = [(int(c), v) for c, v in zip(rng.integers(3, size=200), rng.normal(size=(200, 8)).tolist())] + [(7, [1.0] * 8), (1, None)]
    df = spark.createDataFrame(rows, "class int, vec array<double>")
    got = {}
    for r in M.class_prototypes(df, 12).collect():
        got.setdefault(r["class"], []).append(r["vec"])
    order = df.where("vec is not null").select("class", "vec", F.xxhash64("vec", F.lit(1)).alias("h")).orderBy("h").collect()
    for c in {r["class"] for r in order}:
        m = np.array([r["vec"] for r in order if r["class"] == c])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        centres = m[: max(1, round(12 * len(m) / len(order)))].copy()
        for _ in range(10):
            near = (m @ centres.T).argmax(1)
            for j in range(len(centres)):
                if (near == j).any():
                    centres[j] = m[near == j].sum(0) / np.linalg.norm(m[near == j].sum(0))
        assert np.allclose(np.array(got[c]), centres, atol=1e-9)


@pytest.mark.parametrize("links_per_range", [7, 200_000])
def test_greedy_dedup_of_chains_and_ranges(spark, links_per_range):
    rng = np.random.default_rng(8)
    pairs = sorted({tuple(sorted(map(int, rng.choice(80, 2, replace=False)))) for _ in range(120)} | {(i, i + 1) for i in range(100, 130)})
    dropped = set()
    for a in range(131):
        if a not in dropped:
            dropped |= {b for x, b in pairs if x == a}
    got = {r["id"] for r in split.greedy_dedup(spark.range(131), spark.createDataFrame(pairs, "q_id long, n_id long"), links_per_range=links_per_range).collect()}
    assert got == set(range(131)) - dropped


def test_greedy_dedup_of_a_long_chain_takes_few_jobs(spark):
    rows, links = spark.range(10_000), spark.range(9_999).select(F.col("id").alias("q_id"), (F.col("id") + 1).alias("n_id"))
    spark.sparkContext.setJobGroup("chain", "chain")
    found = split.greedy_dedup(rows, links)
    assert {r["id"] for r in found.collect()} == set(range(0, 10_000, 2))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20
    assert split.greedy_dedup(rows, links.where("false")).count() == 10_000


def test_bootstrap_draws_are_poisson(spark):
    a = spark.createDataFrame([(i, i % 3, 0) for i in range(300)], "q_id long, y int, pred int")
    b = a.withColumn("pred", F.when(F.col("q_id") < 280, F.col("y")).otherwise(F.lit(None)))
    cells = metrics.resampled_cells(a, b, 400)
    sizes = {(r["y"], r["pred"]): r["count"] for r in b.groupBy("y", "pred").count().collect()}
    for r in cells.groupBy("y", "pb").agg(F.avg("w").alias("mean"), F.var_pop("w").alias("var")).collect():
        m = sizes[r["y"], r["pb"]]
        assert abs(r["mean"] - m) < 5 * (m / 400) ** 0.5 + 0.1 and 0.7 * m < r["var"] < 1.4 * m
    found = {r["measure"]: r for r in metrics.paired_bootstrap(a, b, 300, 100).collect()}
    assert found["accuracy"]["verdict"] == "better" == found["macro_f1"]["verdict"] and abs(found["accuracy"]["gain"] - 0.6) < 0.02
    assert [metrics.paired_bootstrap(a.where("false"), b, 50, 20).collect()[k]["resamples"] for k in (0, 1)] == [0, 0]


def test_containment_moves_few_bytes(spark, sf):
    from textengine.operators import quality as Q
    from textengine.plans import views

    b, _ = materialize(views.cleaned(spark, sf), "texts")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    held, before = b.agg(F.sum(F.octet_length("text"))).first()[0], written()
    assert Q.prefix_contained(views.evals(spark, sf), b, 40).count() > 0
    assert written() - before <= 3 * held


def test_cleaning_is_linear_in_long_strings(spark):
    import time

    for text in ("a" * 1_000_000, "x." * 500_000, " " * 1_000_000 + "y", "a@" * 300_000):
        df = spark.createDataFrame([(text,)], "t string")
        began = time.time()
        df.select(F.length(X.clean(F.lit("s"), F.col("t"))), F.size(X.sentences(F.col("t")))).collect()
        assert time.time() - began < 8
    odd = spark.createDataFrame([("a@b c",), ("@a b@ @@c",), ("x a@@b@ y",), ("@ @a@ a@b@c d",)], "t string")
    import re

    for t, got in odd.select("t", X.clean(F.lit(""), F.col("t"))).collect():
        assert got == " ".join(re.sub(r"\S+@\S+", " ", f" . {t}").split())


def test_throttle_by_doubling_equals_one_pass(spark):
    import datetime
    import random

    from textengine.streaming import jobs

    rng, base = random.Random(9), datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), base + datetime.timedelta(seconds=rng.choice([rng.randrange(4000), 60 * rng.randrange(60)]))) for i in range(700)] + [(999, 4, base)]
    got = {r["id"]: r["admitted"] for r in jobs.throttle_once(spark.createDataFrame(rows, "id long, api_key long, created_at timestamp"), 60).collect()}
    last, want = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = key not in last or (at - last[key]).total_seconds() > 60
        if want[i]:
            last[key] = at
    assert got == want and 60 < sum(want.values()) < 300
    assert jobs.throttle_once(spark.createDataFrame([], "id long, api_key long, created_at timestamp")).count() == 0
