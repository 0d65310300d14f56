"""Queries of spark.ml models, plug-ins and user-defined functions (MD, UD, PF-22, EV-31)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textengine.functions import text as X

from textengine.operators import evidence as E
from textengine.operators import families
from textengine.operators import models as M
from textengine.operators import quality as Q
from textengine.operators import similarity as J
from textengine.operators import split as P
from textengine.scratch import drop_table, materialize

from . import neighbours as N
from . import views as S
from .registry import query
from .text import SENTENCES


def labelled(spark, d):
    """Vectors with a fold: the models' features are the given embeddings."""
    v = S.dense(spark, d).select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return v.where(F.col("id") % 5 != 0), v.where(F.col("id") % 5 == 0)


def non_negative(df):
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda x: F.greatest(x, F.lit(0.0)))))


def stacker_rows(spark, d):
    """Pair rows of two channels over the vectors, leave-one-out within the set, with a 0/1 label, written."""
    v = S.dense(spark, d)
    found, path = materialize(J.dense_topk(v, v, 20, same=True), "stacker-neighbours")
    nbrs = E.with_class(found, v, "label")
    classes = v.select(F.col("label").alias("class")).distinct()
    wide = E.channels({"top": (nbrs.where(F.col("rank") <= 5), 0.0), "wide": (nbrs, 0.0)}, classes)
    rows = E.pair_rows(wide, ["top", "wide"]).join(v.select(F.col("id").alias("q_id"), F.col("label").alias("y")), "q_id")
    # Fits and predictions read them many times; they are searched for once.
    rows, _ = materialize(rows.withColumn("label", (F.col("class") == F.col("y")).cast("double")), "stacker")
    drop_table(spark, path)
    return rows


COLUMNS = ["best_top", "cnt_top", "gap_top", "top_top", "best_wide", "cnt_wide", "gap_wide", "top_wide", "class_id"]


#: Rounds of the models that are fitted twice for a comparison; the stacker and the gate have all rounds.
SHORT = 40


def parts(rows):
    return rows.where(F.col("q_id") % 5 != 0), rows.where(F.col("q_id") % 5 == 0)


@query(
    "pf_22_embed",
    """WITH w AS (SELECT id, unnest(string_split(text, ' ')) AS w FROM v_clean), v AS (SELECT id, CAST(CAST('0x' || left(md5(w), 8) AS BIGINT) % 32 AS INTEGER) AS i, sum(CASE WHEN substring(md5(w), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM w WHERE w <> '' GROUP BY ALL),
    n AS (SELECT id, sqrt(sum(x * x)) AS n FROM v GROUP BY id) SELECT c.id, CAST(g.i AS INTEGER) AS i, round(coalesce(v.x / nullif(n.n, 0), 0.0::DOUBLE), 6) AS x FROM v_clean c CROSS JOIN (SELECT unnest(range(0, 32)) AS i) g LEFT JOIN v ON v.id = c.id AND v.i = g.i LEFT JOIN n ON n.id = c.id""",
)
def pf_22(spark, d):
    rows = S.cleaned(spark, d)
    encoder = M.hash_encoder(32)
    known = M.embed(rows.where(F.col("id") % 2 == 0), encoder).join(rows.select("id", F.sha1("text").alias("key")), "id").select("key", "vec").dropDuplicates(["key"])
    return M.embed(rows, encoder, known).select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


@query("md_03_fit_stacker")
def md_03(spark, d):
    rows = stacker_rows(spark, d)
    train, test = parts(rows)
    classes = {"class_id": rows.agg(F.max("class_id")).first()[0] + 1}
    return M.predict_stacker(M.fit_stacker(train, COLUMNS, categories=classes), test, COLUMNS, classes)


@query(
    "md_05_oof_features",
    """WITH f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold), x AS (SELECT p.*, CAST(p.id % 5 AS INTEGER) AS fold FROM v_dense p), s AS (SELECT q.id AS q_id, p.label AS class, round(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(p.vec AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(q.vec AS DOUBLE[])) * list_dot_product(CAST(p.vec AS DOUBLE[]), CAST(p.vec AS DOUBLE[]))), 6) AS sim, p.id AS n_id FROM x q JOIN x p ON p.fold <> q.fold),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, n_id) AS rank FROM s) SELECT q_id, class, max(sim) AS best, count(*) AS cnt FROM r WHERE rank <= 10 GROUP BY q_id, class""",
)
def md_05(spark, d):
    v = S.dense(spark, d)
    best = J.dense_topk(v, v, 10, apart=F.col("id") % 5)
    return E.with_class(best, v, "label").groupBy("q_id", "class").agg(F.max("sim").alias("best"), F.count("*").alias("cnt"))


@query("md_06_logreg")
def md_06(spark, d):
    train, test = labelled(spark, d)
    return M.predict_labels(M.fit_logreg(train, balanced=True), test)


@query("md_06_logreg_text")
def md_06t(spark, d):
    rows = M.text_features(Q.encode_labels(S.cleaned(spark, d), "language").select("id", "text", F.col("label").cast("double").alias("label")))
    return M.predict_labels(M.fit_logreg(rows.where(F.col("id") % 5 != 0)), rows.where(F.col("id") % 5 == 0))


@query("md_07_naive_bayes")
def md_07(spark, d):
    train, test = labelled(spark, d)
    return M.predict_labels(M.fit_nb(non_negative(train)), non_negative(test))


@query("md_08_linear_svm")
def md_08(spark, d):
    train, test = labelled(spark, d)
    return M.predict_labels(M.fit_svm(train), test)


@query("md_10_pair_model")
def md_10(spark, d):
    """Same class or not, cross-fitted: each half is scored by the model of the other."""
    v = S.dense(spark, d)
    nbrs = E.with_class(J.dense_topk(v, v, 10, same=True), v, "label").join(v.select(F.col("id").alias("q_id"), F.col("label").alias("y")), "q_id")
    rows = nbrs.select("q_id", "n_id", "sim", F.col("rank").cast("double").alias("place"), (F.col("class") == F.col("y")).cast("double").alias("label"), X.hash_half(F.col("q_id").cast("string")).alias("half"))
    rows, _ = materialize(rows, "pair-rows")
    out = None
    for half in (0, 1):
        model = M.fit_stacker(rows.where(F.col("half") != half), ["sim", "place"], SHORT)
        got = model.transform(M.assemble(rows.where(F.col("half") == half), ["sim", "place"])).select("q_id", "n_id", F.round(F.get(M.vector_to_array("probability"), F.lit(1)), 6).alias("p"))
        out = got if out is None else out.unionAll(got)
    return out


@query("md_12_prototypes")
def md_12(spark, d):
    return M.class_prototypes(S.dense(spark, d).select(F.col("label").alias("class"), "vec"), 30)


@query("md_13_grid_search")
def md_13(spark, d):
    return M.grid_search(labelled(spark, d)[0], [0.3, 1.0, 3.0, 10.0])


@query("md_17_stack_on")
def md_17(spark, d):
    train, test = parts(stacker_rows(spark, d))
    first = M.predict_stacker(M.fit_stacker(train, COLUMNS[:4], SHORT), train.unionAll(test), COLUMNS[:4])
    both, _ = materialize(E.gap(first, "q_id", "p", "gap_p"), "first-stage")
    columns = [*COLUMNS[4:], "p", "gap_p"]
    train, test = train.join(both, ["q_id", "class"]), test.join(both, ["q_id", "class"])
    return M.predict_stacker(M.fit_stacker(train, columns, SHORT), test, columns)


@query("md_18_flat_stacker")
def md_18(spark, d):
    rows = stacker_rows(spark, d)
    n = [r[0] for r in rows.select("class").distinct().orderBy("class").collect()]  # the classes
    wide = rows.groupBy("q_id", F.col("y").cast("double").alias("label")).pivot("class", n).agg(F.first("best_wide").alias("b"), F.first("cnt_wide").cast("double").alias("c"))
    columns = [f"{c}_{x}" for c in n for x in ("b", "c")]
    train, test = parts(materialize(wide, "flat-rows")[0])
    return M.fit_flat(train, columns).transform(M.assemble(test, columns)).select("q_id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))


@query("md_19_gate")
def md_19(spark, d):
    train, test = parts(stacker_rows(spark, d))
    train = train.withColumn("held", F.pmod(F.xxhash64("q_id"), F.lit(100)) < 15)
    return M.predict_stacker(M.fit_stacker(train, COLUMNS, valid="held"), test, COLUMNS)


@query("md_20_block_ablation")
def md_20(spark, d):
    rows = Q.encode_labels(S.cleaned(spark, d), "language").select("id", F.col("label").cast("double").alias("label"), *[c.cast("double").alias(k) for k, c in X.style_features(F.col("text")).items()], F.coalesce("type", F.lit(-1)).cast("double").alias("type"), F.coalesce("priority", F.lit(-1)).cast("double").alias("priority"))
    text = ["n_chars", "n_words", "n_commas", "n_dots", "mean_word"]
    return M.block_ablation(rows, {"meta": ["type", "priority"], "text": text, "all": [*text, "type", "priority"]})


@query("md_21_column_ablation")
def md_21(spark, d):
    train, test = parts(stacker_rows(spark, d))
    return M.column_ablation(train, test, {"top": COLUMNS[:4], "wide": COLUMNS[4:8]}, SHORT)


@query("ev_31_learning_curve")
def ev_31(spark, d):
    train, test = labelled(spark, d)
    pools = P.growing_pools(train, (0.5, 1.0), 1, "label")
    out = None
    for f in (0.5, 1.0):
        got = M.predict_labels(M.fit_logreg(pools.where(F.col("frac") == f)), test).withColumn("frac", F.lit(f))
        out = got if out is None else out.unionAll(got)
    return out.groupBy("frac").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("y")).cast("double")), 4).alias("accuracy"))


_COUNT = "length(text) - length(replace(text, '{0}', ''))"
_NORM = "sqrt(" + " + ".join(f"pow({_COUNT.format(c)}, 2)" for c in "abcdefghijklmnopqrstuvwxyz") + ")"


@query("ud_01_embed", f"SELECT id, round(CASE WHEN n > 0 THEN e / n ELSE 0 END, 6) AS e, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 6) AS s FROM (SELECT id, {_NORM} AS n, {_COUNT.format('e')} AS e, {_COUNT.format('s')} AS s FROM v_clean)")
def ud_01(spark, d):
    """The pluggable encoder, with one that counts letters."""
    vec = M.embed(N.docs(spark, d).select("id", "text"), M.letter_encoder())
    return vec.select("id", *[F.round(F.get("vec", F.lit(ord(c) - ord("a"))), 6).alias(c) for c in "es"])


@query(
    "ud_02_translate",
    f"""WITH s AS (SELECT id, unnest(s) AS source, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id AS id, {SENTENCES.format('text')} AS s FROM documents))
    SELECT id, string_agg(replace(source, 'e', '3'), ' ' ORDER BY pos) AS text FROM s GROUP BY id""",
)
def ud_02(spark, d):
    """The pluggable translator, with one that replaces a letter, and no cache."""
    rows = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    none = spark.createDataFrame([], "source string, target string")
    return families.translate_pool(rows, none, lambda batch: [s.replace("e", "3") for s in batch])


@query("ud_03_block_product", "SELECT q_id, n_id, sim FROM v_search WHERE rank <= 5")
def ud_03(spark, d):
    """The blocked matrix product, in blocks far smaller than the table."""
    return J.dense_topk(*N.search(spark, d), 5, same=True, rows_per_block=300).select("q_id", "n_id", "sim")


_WORDS = "len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''))"


@query(
    "ud_05_pack_in_order",
    f"""WITH r AS (SELECT id, list_transform(s, lambda s: [CAST({_WORDS} AS BIGINT)]) AS s FROM (SELECT doc_id AS id, {SENTENCES.format('text')} AS s FROM documents))
    SELECT id, array_to_string(list_reduce(s, lambda a, x: CASE WHEN len(a) > 0 AND a[-1] + x[1] <= 120 THEN list_append(a[:-2], a[-1] + x[1]) ELSE list_append(a, x[1]) END, CAST([] AS BIGINT[])), ' ') AS bins FROM r WHERE len(s) > 0""",
)
def ud_05(spark, d):
    """An order-sensitive fold: sentences of each document packed into windows of 120 words."""
    from textengine.functions.text import sentences
    from textengine.operators.quality import pack_in_order

    rows = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    n = F.size(F.filter(F.split("s", r"\s+"), lambda w: w != ""))
    return pack_in_order(rows, "id", "i", n, 120).select("id", F.array_join(F.transform("bins", lambda b: b.cast("string")), " ").alias("bins"))


@query(
    "ud_06_table_functions",
    rf"""SELECT doc_id AS id, 'sentence' AS kind, CAST(i - 1 AS INTEGER) AS pos, s AS value FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents))
    UNION ALL SELECT id, 'gram', CAST(i AS INTEGER), t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] FROM (SELECT id, t, unnest(range(0, greatest(len(t) - 2, 0))) AS i FROM (SELECT item_id AS id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM benchmark))""",
)
def ud_06(spark, d):
    """Table functions of SQL, in LATERAL joins."""
    from textengine.functions.register import register_all

    register_all(spark)
    S.table(spark, d, "documents").createOrReplaceTempView("te_documents")
    S.table(spark, d, "benchmark").createOrReplaceTempView("te_benchmark")
    return spark.sql(
        "SELECT doc_id AS id, 'sentence' AS kind, pos, sentence AS value FROM te_documents, LATERAL te_sentences(text)"
        " UNION ALL SELECT item_id, 'gram', pos, gram FROM te_benchmark, LATERAL te_ngrams(text, 3)"
    )


@query("ud_04_lcs_ratio")
def ud_04(spark, d):
    rows = N.docs(spark, d).select("id", "text")
    pairs = N.loo_topk(spark, d, 1).select("q_id", "n_id")
    pairs = pairs.join(rows.select(F.col("id").alias("q_id"), F.col("text").alias("a")), "q_id").join(rows.select(F.col("id").alias("n_id"), F.col("text").alias("b")), "n_id")
    return M.lcs_ratio(pairs, "a", "b").select("q_id", "n_id", F.round("ratio", 6).alias("ratio"))


@query("ud_07_sql_functions", "SELECT id, regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g') <> '' AS some, instr(text, ' . ') > 0 AS has_subject FROM v_clean")
def ud_07(spark, d):
    from textengine.functions.register import register_all

    register_all(spark)
    S.cleaned(spark, d).createOrReplaceTempView("te_clean")
    return spark.sql("SELECT id, te_slug(concat(text, 'x')) <> '' AS some, te_subject(text) <> '' OR instr(text, ' . ') > 0 AS has_subject FROM te_clean")



