"""Queries of similarity joins, evidence and decisions (JN, AG, MD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textengine.functions import text as X
from textengine.operators import chunks as C
from textengine.operators import decide as D
from textengine.operators import evidence as E
from textengine.operators import ivf as I
from textengine.operators import quality as Q
from textengine.operators import similarity as J
from textengine.operators import vectorize as V
from textengine.scratch import drop_written

from . import views as S
from .registry import VIEWS, query
from .vectors import docs

#: TF-IDF fitted on the English pool, applied to the foreign pool and to the evaluation texts.
_T = r"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM {0}) GROUP BY id, term"
VIEWS["v_en_terms"] = _T.replace("{0}", "v_en")
VIEWS["v_xx_terms"] = _T.replace("{0}", "v_xx")
VIEWS["v_eval_terms"] = _T.replace("{0}", "v_eval")
VIEWS["v_en_idf"] = "SELECT term, ln((1 + (SELECT count(*) FROM v_en)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM v_en_terms GROUP BY term HAVING count(*) >= 2"
_W = "SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, (1 + ln(tf)) * idf AS w FROM {0} JOIN {1} USING (term))"
VIEWS["v_en_w"] = _W.format("v_en_terms", "v_en_idf")
VIEWS["v_xx_w"] = _W.format("v_xx_terms", "v_en_idf")
VIEWS["v_eval_w"] = _W.format("v_eval_terms", "v_idf")
_NN = "SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, n_id) AS rank FROM (SELECT q.id AS q_id, p.id AS n_id, round(sum(q.w * p.w), 6) AS sim FROM {0} q JOIN {1} p USING (term) {2} GROUP BY q.id, p.id)"
VIEWS["v_near_all"] = _NN.format("v_xx_w", "v_en_w", "")
VIEWS["v_near"] = "SELECT n.*, c.queue AS class FROM v_near_all n JOIN v_clean c ON c.id = n.n_id WHERE rank <= 20"
VIEWS["v_loo_all"] = _NN.format("v_tfidf", "v_tfidf", "WHERE q.id <> p.id")
VIEWS["v_loo"] = "SELECT n.*, c.queue AS class FROM v_loo_all n JOIN v_clean c ON c.id = n.n_id WHERE rank <= 20"
VIEWS["v_dn_all"] = """SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, n_id) AS rank FROM (SELECT q.id AS q_id, p.id AS n_id,
 round(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(p.vec AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(q.vec AS DOUBLE[])) * list_dot_product(CAST(p.vec AS DOUBLE[]), CAST(p.vec AS DOUBLE[]))), 6) AS sim
 FROM v_dense q, v_dense p WHERE q.id % 5 = 0 AND p.id % 5 <> 0)"""
VIEWS["v_search"] = VIEWS["v_dn_all"].replace("q.id % 5 = 0 AND p.id % 5 <> 0", "q.id % 20 = 0 AND p.id <> q.id")
VIEWS["v_dn"] = "SELECT n.*, d.label AS class FROM v_dn_all n JOIN v_dense d ON d.id = n.n_id WHERE rank <= 20"
VIEWS["v_classes"] = "SELECT DISTINCT queue AS class FROM v_clean"
BANDS = [(0.0, 0.2), (0.2, 0.3), (0.3, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 1.01)]
VIEWS["v_bands"] = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in BANDS) + ") t(low, high)"


def chunks(spark, d):
    return C.term_chunks(S.pool_xx(spark, d)), C.term_chunks(S.pool_en(spark, d))


def sides(spark, d):
    """TF-IDF of the foreign and the English pool, fitted on the English one, as blocks."""
    return C.search_sides(*chunks(spark, d))


def near(spark, d, k: int = 20):
    return E.with_class(J.sparse_topk(*sides(spark, d), k), docs(spark, d))


def all_w(spark, d, form: str = "rows"):
    return V.tfidf_view(docs(spark, d), form=form)


def all_blocks(spark, d):
    """TF-IDF of all rows, fitted on them, as blocks."""
    return C.own_blocks(C.term_chunks(docs(spark, d)))


def loo_topk(spark, d, k: int):
    return J.loo_topk(all_blocks(spark, d), k)


def loo(spark, d, k: int = 20):
    return E.with_class(loo_topk(spark, d, k), docs(spark, d))


def guard_sides(spark, d):
    """TF-IDF of all rows and of the evaluation texts, fitted on all rows."""
    rows = C.term_chunks(docs(spark, d))
    return C.weights(rows, rows, form="queries"), C.weights(C.term_chunks(S.evals(spark, d)), rows, form="pool")


def halves(spark, d):
    v = S.dense(spark, d)
    return v.where(F.col("id") % 5 == 0), v.where(F.col("id") % 5 != 0)


def dn(spark, d, k: int = 20):
    q, p = halves(spark, d)
    return E.with_class(J.dense_topk(q, p, k), S.dense(spark, d), "label")


def classes(spark, d):
    return docs(spark, d).select(F.col("queue").alias("class")).distinct()


def rnd(*names, places=6):
    return [F.round(n, places).alias(n) for n in names]


@query("jn_01_sparse_topk", "SELECT q_id, n_id, sim, rank FROM v_near_all WHERE rank <= 20")
def jn_01(spark, d):
    return J.sparse_topk(*sides(spark, d), 20).select("q_id", "n_id", "sim", "rank")


def search(spark, d):
    """Every row whose id is divisible by 20, and all rows."""
    v = S.dense(spark, d)
    return v.where(F.col("id") % 20 == 0), v


@query("jn_02_dense_topk", "SELECT q_id, n_id, sim, rank FROM v_search WHERE rank <= 20")
def jn_02(spark, d):
    return I.exact_topk(*search(spark, d), 20, same=True)[0].select("q_id", "n_id", "sim", "rank")


@query("jn_03_max_sim", "SELECT x.id, coalesce(n.sim, 0.0) AS sim, n.n_id FROM (SELECT DISTINCT id FROM v_xx_w) x LEFT JOIN v_near_all n ON n.q_id = x.id AND rank = 1")
def jn_03(spark, d):
    return J.max_sim(*sides(spark, d))


@query("jn_04_loo_topk", "SELECT q_id, n_id, sim, rank FROM v_loo_all WHERE rank <= 10")
def jn_04(spark, d):
    return loo_topk(spark, d, 10).select("q_id", "n_id", "sim", "rank")


@query("jn_05_sim_join", "SELECT q_id, n_id, sim FROM v_loo_all WHERE q_id < n_id AND sim >= 0.4 AND sim < 0.85")
def jn_05(spark, d):
    w = all_blocks(spark, d)
    return J.sim_join(w, w, 0.4, 0.85, same=True)


VIEWS["v_guard"] = f"""SELECT p.id, coalesce(s.sim, 0.0) AS sparse, CAST(NULL AS DOUBLE) AS dense FROM (SELECT DISTINCT id FROM v_tfidf) p LEFT JOIN
 (SELECT q_id, max(sim) AS sim FROM ({_NN.format('v_tfidf', 'v_eval_w', '')}) GROUP BY q_id) s ON s.q_id = p.id"""


def guard(spark, d):
    """Similarities from 0.3 on, the least threshold of all guards; below it they are 0."""
    return J.guard_sims(*guard_sides(spark, d), low=0.3)


@query("jn_06_leak_guard", "SELECT id FROM v_clean WHERE id NOT IN (SELECT id FROM v_guard WHERE sparse >= 0.3)")
def jn_06(spark, d):
    return J.leak_guard(docs(spark, d), guard(spark, d), 0.3).select("id")


@query("jn_06_guard_summary", "SELECT count(*) AS n, count(*) FILTER (sparse >= 0.3) AS dropped_sparse, CAST(0 AS BIGINT) AS dropped_dense_only, count(*) FILTER (sparse < 0.3) AS n_kept FROM v_guard")
def jn_06s(spark, d):
    return J.guard_summary(guard(spark, d), 0.3)


@query("jn_07_pair_dot", "SELECT a.id AS q_id, a.id + 1 AS n_id, round(coalesce((SELECT sum(x.w * y.w) FROM v_tfidf x JOIN v_tfidf y ON x.term = y.term WHERE x.id = a.id AND y.id = a.id + 1), 0.0), 6) AS sim FROM v_clean a")
def jn_07(spark, d):
    w = all_w(spark, d, "lists")
    pairs = docs(spark, d).select(F.col("id").alias("q_id"), (F.col("id") + 1).alias("n_id"))
    return J.pair_dot(pairs, w, w).withColumn("sim", F.round("sim", 6))


@query("jn_08_guard_extra", "SELECT id FROM v_xx WHERE text NOT IN (SELECT text FROM v_en) AND id NOT IN (SELECT q_id FROM v_near_all WHERE sim >= 0.95)")
def jn_08(spark, d):
    return J.guard_extra(S.pool_xx(spark, d), S.pool_en(spark, d), J.max_sim(*sides(spark, d))).select("id")


@query("jn_09_embedding_guard", "SELECT id FROM v_dense WHERE id % 20 = 0 AND id NOT IN (SELECT q_id FROM v_search WHERE rank = 1 AND sim >= 0.4)")
def jn_09(spark, d):
    q, p = search(spark, d)
    sims = J.dense_topk(q, p, 1, same=True).select(F.col("q_id").alias("id"), F.lit(None).cast("double").alias("sparse"), F.col("sim").alias("dense"))
    return J.leak_guard(q, sims, None, 0.4).select("id")


@query("jn_10_guard_sweep", "SELECT t.thr_sparse, CAST(NULL AS DOUBLE) AS thr_dense, count(*) AS n, count(*) FILTER (sparse >= t.thr_sparse) AS n_dropped FROM v_guard, (SELECT unnest([NULL, 0.7::DOUBLE, 0.6::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE]) AS thr_sparse) t GROUP BY t.thr_sparse")
def jn_10(spark, d):
    return J.guard_sweep(guard(spark, d), [(None, None), (0.7, None), (0.6, None), (0.5, None), (0.3, None)])


@query(
    "jn_11_candidates",
    f"""WITH b AS (SELECT id, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS w, term FROM v_xx_terms JOIN v_en_idf USING (term)), e AS (SELECT id, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS w, term FROM v_en_terms JOIN v_en_idf USING (term)),
    n AS ({_NN.format('b', 'e', '')}), c AS (SELECT q_id, n_id FROM v_near_all WHERE rank <= 5 UNION SELECT q_id, n_id FROM n WHERE rank <= 5)
    SELECT c.q_id, c.n_id, a.sim AS tf, rank() OVER (PARTITION BY c.q_id ORDER BY a.sim DESC) AS tf_rank, round(max(a.sim) OVER (PARTITION BY c.q_id) - a.sim, 6) AS tf_margin,
    n.sim AS bin, rank() OVER (PARTITION BY c.q_id ORDER BY n.sim DESC) AS bin_rank, round(max(n.sim) OVER (PARTITION BY c.q_id) - n.sim, 6) AS bin_margin
    FROM c JOIN v_near_all a ON a.q_id = c.q_id AND a.n_id = c.n_id JOIN n ON n.q_id = c.q_id AND n.n_id = c.n_id""",
)
def jn_11(spark, d):
    xx, en = chunks(spark, d)
    views = {name: tuple(C.weights(x, en, binary=name == "bin", form=f) for x, f in ((xx, "queries"), (en, "pool"))) for name in ("tf", "bin")}
    for x in (xx, en):
        drop_written(x)
    return J.candidates(views, 5)


_SENT = r"len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?:;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> ''))"


@query(
    "jn_12_pair_extras",
    rf"""WITH r AS (SELECT id, list(term) AS r FROM (SELECT id, term, count(*) OVER (PARTITION BY term) AS df FROM (SELECT DISTINCT id, unnest(regexp_extract_all(text, '[a-z][a-z0-9\-]{{2,}}')) AS term FROM v_clean)) WHERE df BETWEEN 2 AND 30 GROUP BY id),
    f AS (SELECT c.id, length(text) AS n, {_SENT} AS s, coalesce(r.r, []) AS r FROM v_clean c LEFT JOIN r ON r.id = c.id)
    SELECT q_id, n_id, round(least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE, 6) AS length_ratio, CAST(len(list_intersect(a.r, b.r)) AS BIGINT) AS shared,
    round(len(list_intersect(a.r, b.r)) / greatest(least(len(a.r), len(b.r)), 1)::DOUBLE, 6) AS shared_share, CAST(abs(a.s - b.s) AS BIGINT) AS sentence_gap
    FROM v_loo_all p JOIN f a ON a.id = q_id JOIN f b ON b.id = n_id WHERE rank <= 3""",
)
def jn_12(spark, d):
    rows = docs(spark, d)
    return J.pair_extras(loo_topk(spark, d, 3), rows.select("id", "text"), V.rare_tokens(rows))


@query("jn_13_class_candidates", "SELECT q_id, class, arg_max(n_id, (sim, -n_id)) AS n_id, max(sim) AS sim, count(*) AS cnt, round(avg(sim), 8) AS mean_sim, list_sort(list(sim), 'DESC')[2] AS second_sim FROM v_near GROUP BY q_id, class")
def jn_13(spark, d):
    return J.class_candidates(near(spark, d))


@query("jn_14_attach_meta", "SELECT c.id, m.id AS raw_id, m.queue AS raw_queue FROM v_clean c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS n FROM v_clean) m ON m.text = c.text AND m.n = 1")
def jn_14(spark, d):
    return J.attach_meta(docs(spark, d).select("id", "text"), docs(spark, d)).select("id", "raw_id", "raw_queue")


@query("jn_15_corrected_texts", "SELECT p.text, arg_max(f.correct_queue, (f.created_at, f.id)) AS label FROM v_pred p JOIN v_fb f ON f.ticket_id = p.id WHERE f.api_key NOT IN (1, 2) GROUP BY p.text")
def jn_15(spark, d):
    return J.corrected_texts(S.predictions(spark, d), S.feedback(spark, d), [1, 2])


@query("jn_16_orphan_feedback", "SELECT 'orphan' AS kind, ticket_id FROM v_fb WHERE ticket_id NOT IN (SELECT id FROM v_pred) UNION ALL SELECT 'class', ticket_id FROM v_fb WHERE correct_queue NOT IN (SELECT DISTINCT queue FROM v_pred WHERE queue <> 'error')")
def jn_16(spark, d):
    fb, p = S.feedback(spark, d), S.predictions(spark, d)
    known = p.select("queue").where(F.col("queue") != "error").distinct()
    return J.orphan_feedback(fb, p).select(F.lit("orphan").alias("kind"), "ticket_id").union(J.bad_class(fb, known).select(F.lit("class"), "ticket_id"))


@query("jn_17_twin_check", "SELECT low, count(*) AS n, round(avg(CASE WHEN a.queue = b.queue AND a.type IS NOT DISTINCT FROM b.type AND a.priority IS NOT DISTINCT FROM b.priority THEN 1.0 ELSE 0.0 END), 6) AS twin_share FROM v_loo_all n JOIN v_clean a ON a.id = q_id JOIN v_clean b ON b.id = n_id JOIN v_bands ON sim >= low AND sim < high WHERE rank = 1 GROUP BY low")
def jn_17(spark, d):
    return J.twin_check(loo_topk(spark, d, 1), docs(spark, d), BANDS, ("queue", "type", "priority"))


@query("jn_18_fuse", "SELECT q_id, n_id, round(sim + 5.0 * (sim * sim), 6) AS summed, round((sim + sim * sim) / 2, 6) AS mean, greatest(sim, sim * sim) AS most, round(0.3 * (sim * sim) + 0.7 * sim, 6) AS convex FROM v_near_all WHERE rank <= 20")
def jn_18(spark, d):
    rows = J.sparse_topk(*sides(spark, d), 20).select("q_id", "n_id", F.col("sim").alias("lex"), (F.col("sim") * F.col("sim")).alias("emb"))
    f = lambda how, w=5.0: F.round(J.fuse(rows, how, ["emb"], ["lex"], w), 6)
    return rows.select("q_id", "n_id", f("sum").alias("summed"), f("mean").alias("mean"), f("max").alias("most"), f("convex", 0.3).alias("convex"))


@query("jn_19_approx_topk")
def jn_19(spark, d):
    return I.search(*search(spark, d), 10)


@query(
    "jn_20_match_labels",
    """WITH a AS (SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN ' SRC' || (item_id % 25) WHEN item_id % 3 = 1 THEN 'src' || (item_id % 10) || ' because' ELSE 'none' END AS answer FROM benchmark),
    l AS (SELECT queue, row_number() OVER (ORDER BY queue) - 1 AS label FROM (SELECT DISTINCT queue FROM v_clean))
    SELECT id, answer, label FROM (SELECT a.id, a.answer, l.label, row_number() OVER (PARTITION BY a.id ORDER BY lower(trim(answer)) = queue DESC NULLS LAST, label) AS n
    FROM a LEFT JOIN l ON starts_with(lower(trim(answer)), queue) OR starts_with(queue, lower(trim(answer)))) WHERE n = 1""",
)
def jn_20(spark, d):
    i = F.col("item_id")
    answer = F.when(i % 3 == 0, F.concat(F.lit(" SRC"), (i % 25).cast("string"))).when(i % 3 == 1, F.concat(F.lit("src"), (i % 10).cast("string"), F.lit(" because"))).otherwise("none")
    a = S.table(spark, d, "benchmark").select(i.alias("id"), answer.alias("answer"))
    return J.match_labels(a, Q.encode_labels(docs(spark, d), "queue").select("queue", F.col("label").cast("long").alias("label")).distinct())


PER_CLASS = """SELECT g.q_id, g.class, CASE WHEN f.cnt = g.k THEN f.top ELSE greatest(coalesce(f.top, {1}), {1}) END AS best, coalesce(f.cnt, 0) AS cnt
 FROM (SELECT q_id, class, k FROM (SELECT q_id, count(*) AS k FROM {0} GROUP BY q_id), {2}) g LEFT JOIN (SELECT q_id, class, max(sim) AS top, count(*) AS cnt FROM {0} GROUP BY q_id, class) f USING (q_id, class)"""
VIEWS["v_ev"] = PER_CLASS.format("v_near", "0.05::DOUBLE", "v_classes")
VIEWS["v_chan"] = "SELECT a.q_id, a.class, a.best AS best_top, a.cnt AS cnt_top, b.best AS best_wide, b.cnt AS cnt_wide FROM (" + PER_CLASS.format("(SELECT * FROM v_near WHERE rank <= 5)", "0.0::DOUBLE", "v_classes") + ") a JOIN v_ev b USING (q_id, class)"


def evidence(spark, d):
    return E.per_class(near(spark, d), classes(spark, d), 0.05)


def chan(spark, d):
    n = near(spark, d)
    return E.channels({"top": (n.where(F.col("rank") <= 5), 0.0), "wide": (n, 0.05)}, classes(spark, d))


@query("ag_01_per_class", "SELECT q_id, class, best, cnt FROM v_ev")
def ag_01(spark, d):
    return evidence(spark, d)


@query("ag_02_channels", "SELECT * FROM v_chan")
def ag_02(spark, d):
    return chan(spark, d)


VIEWS["v_top2"] = "SELECT q_id, list_sort(list(best_top), 'DESC') AS a, list_sort(list(best_wide), 'DESC') AS b FROM v_chan GROUP BY q_id"


@query(
    "ag_03_pair_rows",
    """SELECT c.*, round(best_top - CASE WHEN best_top >= a[1] THEN a[2] ELSE a[1] END, 6) AS gap_top, a[1] AS top_top, round(best_wide - CASE WHEN best_wide >= b[1] THEN b[2] ELSE b[1] END, 6) AS gap_wide, b[1] AS top_wide,
    CAST(dense_rank() OVER (PARTITION BY q_id ORDER BY class) - 1 AS INTEGER) AS class_id FROM v_chan c JOIN v_top2 USING (q_id)""",
)
def ag_03(spark, d):
    rows = E.pair_rows(chan(spark, d), ["top", "wide"])
    return rows.withColumns({c: F.round(c, 6) for c in ("gap_top", "gap_wide")})


@query(
    "ag_04_class_feats",
    """WITH r AS (SELECT n.*, c.queue AS class FROM v_near_all n JOIN v_clean c ON c.id = n.n_id), b AS (SELECT g.q_id, g.class, coalesce(max(sim), -1.0) AS best, coalesce(sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank END), 0.0) / 2.9289682539682538 AS vote, count(*) FILTER (rank <= 5) / 5.0::DOUBLE AS cnt5
    FROM (SELECT q_id, class FROM (SELECT DISTINCT q_id FROM r), v_classes) g LEFT JOIN r USING (q_id, class) GROUP BY g.q_id, g.class), t AS (SELECT q_id, list_sort(list(best), 'DESC') AS m FROM b GROUP BY q_id)
    SELECT b.q_id, b.class, b.best, round(b.vote, 6) AS vote, b.cnt5, round(b.best - CASE WHEN b.best >= m[1] THEN m[2] ELSE m[1] END, 6) AS gap, s.s1, s.s5, s.top1 FROM b JOIN t USING (q_id)
    JOIN (SELECT q_id, max(sim) FILTER (rank = 1) AS s1, max(sim) FILTER (rank = 5) AS s5, max(class) FILTER (rank = 1) AS top1 FROM r GROUP BY q_id) s USING (q_id)""",
)
def ag_04(spark, d):
    labels = docs(spark, d).select("id", F.col("queue").alias("class"))
    queries, pool = sides(spark, d)
    best = J.best_per_class(queries, pool, labels)
    nbrs = E.with_class(J.sparse_topk(queries, pool, 10), docs(spark, d))
    rows = E.class_feats(nbrs, best, classes(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("vote", "gap")})


@query("ag_05_knn_vote", "SELECT q_id, class, round(v / greatest(sum(v) OVER (PARTITION BY q_id), 1e-12), 6) AS p FROM (SELECT q_id, class, sum(pow(greatest(sim - 0.02, 0), 4)) AS v FROM v_near WHERE rank <= 10 GROUP BY q_id, class)")
def ag_05(spark, d):
    return E.knn_vote(near(spark, d), 10, 4, 0.02).select("q_id", "class", *rnd("p"))


@query("ag_06_knn_softvote", "SELECT q_id, class, round(v / sum(v) OVER (PARTITION BY q_id), 6) AS p FROM (SELECT q_id, class, sum(e) AS v FROM (SELECT q_id, class, exp((sim - max(sim) OVER (PARTITION BY q_id)) / 0.05) AS e FROM v_near WHERE rank <= 10) GROUP BY q_id, class)")
def ag_06(spark, d):
    return E.knn_softvote(near(spark, d), 10, 0.05).select("q_id", "class", *rnd("p"))


@query("ag_07_agreement", "SELECT v.q_id, v.class, v.votes, round(p.purity, 6) AS purity FROM (SELECT q_id, class, count(*) AS votes FROM (SELECT q_id, class FROM v_near WHERE rank = 1 UNION ALL SELECT q_id, class FROM v_near WHERE rank = 1) GROUP BY q_id, class) v JOIN (SELECT n.q_id, avg(CASE WHEN n.class = f.class THEN 1.0::DOUBLE ELSE 0.0 END) AS purity FROM v_near n JOIN v_near f ON f.q_id = n.q_id AND f.rank = 1 WHERE n.rank <= 5 GROUP BY n.q_id) p USING (q_id)")
def ag_07(spark, d):
    n = near(spark, d, 5)
    return E.agreement({"a": n, "b": n}).join(E.purity(n), "q_id").select("q_id", "class", "votes", *rnd("purity"))


@query("ag_08_noisy_or", "SELECT q_id, class, round(1 - exp(sum(ln(1 - least(sim, 0.999)))), 6) AS noisy_or, max(sim) AS most FROM v_near GROUP BY q_id, class")
def ag_08(spark, d):
    return E.noisy_or(near(spark, d), "sim").select("q_id", "class", *rnd("noisy_or"), "most")


@query("ag_09_per_source_class", "SELECT q_id, c.type AS source, n.class, max(sim) AS best FROM v_near n JOIN v_clean c ON c.id = n.n_id GROUP BY ALL")
def ag_09(spark, d):
    n = near(spark, d).join(docs(spark, d).select(F.col("id").alias("n_id"), F.col("type").alias("source")), "n_id")
    return E.per_source_class(n, "source")


@query(
    "ag_10_context_feats",
    r"""SELECT n.q_id, max(sim) FILTER (rank = 1) AS s1, max(sim) FILTER (rank = 2) AS s2, max(sim) FILTER (rank = 5) AS s5, round(avg(sim) FILTER (rank <= 10), 8) AS mean10, coalesce(max(sim) FILTER (class <> f), 0.0) AS rival,
    round(max(sim) FILTER (rank = 1) - coalesce(max(sim) FILTER (class <> f), 0.0), 6) AS margin, any_value(w.n) AS n_words FROM v_near n JOIN (SELECT q_id, class AS f FROM v_near WHERE rank = 1) USING (q_id)
    JOIN (SELECT id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n FROM v_clean) w ON w.id = n.q_id GROUP BY n.q_id""",
)
def ag_10(spark, d):
    words = docs(spark, d).select("id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("n_words"))
    return E.context_feats(near(spark, d), words).withColumns({"mean10": F.round("mean10", 8), "margin": F.round("margin", 6)})


@query("ag_11_class_ranks", "SELECT q_id, class, CAST(rank() OVER (PARTITION BY q_id ORDER BY best DESC) - 1 AS INTEGER) AS best_rank, CAST(rank() OVER (PARTITION BY q_id ORDER BY cnt DESC) - 1 AS INTEGER) AS cnt_rank FROM v_ev")
def ag_11(spark, d):
    rows = E.class_ranks(E.class_ranks(evidence(spark, d), "best", "best_rank"), "cnt", "cnt_rank")
    return rows.select("q_id", "class", "best_rank", "cnt_rank")


@query("ag_12_class_prior", "SELECT queue AS class, round(count(*) / (SELECT count(*) FROM v_clean)::DOUBLE, 6) AS prior FROM v_clean GROUP BY queue")
def ag_12(spark, d):
    return E.class_prior(docs(spark, d), "queue").select("class", *rnd("prior"))


@query(
    "ag_13_centroid_evidence",
    f"""WITH s AS (SELECT f.queue AS id, term, sum(w) AS w FROM v_en_w JOIN v_clean f USING (id) GROUP BY f.queue, term), c AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM s), z AS (SELECT queue, count(*) AS n FROM v_en GROUP BY queue)
    SELECT q.id AS q_id, c.id AS class, round(sum(q.w * c.w), 6) AS best, round(any_value(ln(1 + z.n)), 6) AS log_size FROM v_xx_w q JOIN c USING (term) JOIN z ON z.queue = c.id GROUP BY q.id, c.id""",
)
def ag_13(spark, d):
    en = S.pool_en(spark, d)
    xx, pool = chunks(spark, d)
    c = E.centroids(C.weights(pool, pool), en.select("id", F.col("queue").alias("family")))
    size = en.groupBy(F.col("queue").alias("class")).agg(F.round(F.log1p(F.count("*")), 6).alias("log_size"))
    return J.sparse_pairs(C.weights(xx, pool), c).select("q_id", F.col("n_id").alias("class"), F.round("sim", 6).alias("best")).join(size, "class")


@query("ag_14_familiarity", "SELECT q_id, max(greatest(best_top, best_wide)) AS familiarity FROM v_chan GROUP BY q_id")
def ag_14(spark, d):
    return E.nearest_similarity(chan(spark, d), ["best_top", "best_wide"])


@query("md_01_nn_label", "SELECT q_id, class AS pred, sim FROM v_near WHERE rank = 1")
def md_01(spark, d):
    return D.nn_label(near(spark, d, 1))


@query("md_02_hybrid", "SELECT c.id AS q_id, CASE WHEN n.sim >= 0.3 THEN n.class ELSE 'src0' END AS pred FROM v_xx c LEFT JOIN v_near n ON n.q_id = c.id AND n.rank = 1")
def md_02(spark, d):
    fallback = S.pool_xx(spark, d).select(F.col("id").alias("q_id"), F.lit("src0").alias("pred"))
    return D.hybrid(D.nn_label(near(spark, d, 1)), fallback, 0.3)


VIEWS["v_dprob"] = "SELECT q_id, class, v / sum(v) OVER (PARTITION BY q_id) AS p FROM (SELECT q_id, class, sum(pow(greatest(sim, 0), 4)) AS v FROM v_dn WHERE rank <= 10 GROUP BY q_id, class)"
VIEWS["v_dprob2"] = "SELECT q_id, class, v / sum(v) OVER (PARTITION BY q_id) AS p FROM (SELECT q_id, class, sum(pow(greatest(sim, 0), 1)) AS v FROM v_dn WHERE rank <= 20 GROUP BY q_id, class)"
VIEWS["v_dpred"] = "SELECT q_id, y, pred, conf, sim FROM (SELECT p.q_id, d.label AS y, p.class AS pred, p.p AS conf, n.sim, row_number() OVER (PARTITION BY p.q_id ORDER BY round(p.p, 9) DESC, p.class) AS r FROM v_dprob p JOIN v_dense d ON d.id = p.q_id JOIN v_dn n ON n.q_id = p.q_id AND n.rank = 1) WHERE r = 1"


def dprob(spark, d, k: int = 10, power: float = 4):
    return E.knn_vote(dn(spark, d), k, power)


def dtruth(spark, d):
    return S.dense(spark, d).select(F.col("id").alias("q_id"), F.col("label").alias("y"))


def dpred(spark, d):
    """(q_id, y, pred, conf, sim): decisions on the held-out fifth of the vectors."""
    n = dn(spark, d)
    top = D.decide(E.knn_vote(n, 10, 4), 0.7).select("q_id", "pred", F.col("confidence").alias("conf"))
    return top.join(dtruth(spark, d), "q_id").join(n.where(F.col("rank") == 1).select("q_id", "sim"), "q_id")


@query(
    "md_04_decide",
    "SELECT q_id, max(class) FILTER (r = 1) AS pred, round(max(p) FILTER (r = 1), 6) AS confidence, string_agg(class || ':' || printf('%.4f', round(p, 4)), ' ' ORDER BY r) AS top3, max(p) FILTER (r = 1) >= 0.7 AS auto FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(p, 9) DESC, class) AS r FROM v_dprob) WHERE r <= 3 GROUP BY q_id",
)
def md_04(spark, d):
    rows = D.decide(dprob(spark, d), 0.7)
    return rows.select("q_id", "pred", *rnd("confidence"), F.array_join(F.transform("top3", lambda t: F.concat(t["queue"].cast("string"), F.lit(":"), F.format_string("%.4f", t["p"]))), " ").alias("top3"), "auto")


@query(
    "md_09_ensemble",
    """WITH c AS (SELECT DISTINCT label AS class FROM v_dense), g AS (SELECT q_id, class FROM (SELECT DISTINCT q_id FROM v_dprob), c), m AS (SELECT g.q_id, g.class, exp((ln(greatest(coalesce(a.p, 1e-6), 1e-6)) + ln(greatest(coalesce(b.p, 1e-6), 1e-6))) / 2) AS s
    FROM g LEFT JOIN v_dprob a ON a.q_id = g.q_id AND a.class = g.class LEFT JOIN v_dprob2 b ON b.q_id = g.q_id AND b.class = g.class) SELECT q_id, class, round(s / sum(s) OVER (PARTITION BY q_id), 6) AS p FROM m""",
)
def md_09(spark, d):
    c = S.dense(spark, d).select(F.col("label").alias("class")).distinct()
    return D.ensemble([dprob(spark, d), dprob(spark, d, 20, 1)], c).select("q_id", "class", *rnd("p"))


@query(
    "md_11_fit_temperature",
    """WITH s AS (SELECT q_id, class, t, pow(greatest(p, 1e-12), 1 / t) AS s FROM v_dprob, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 4.0::DOUBLE]) AS t)), q AS (SELECT q_id, class, t, s / sum(s) OVER (PARTITION BY q_id, t) AS q FROM s)
    SELECT t, round(avg(-ln(greatest(q, 1e-12))), 6) AS log_loss FROM q JOIN v_dense d ON d.id = q.q_id AND d.label = q.class GROUP BY t""",
)
def md_11(spark, d):
    return D.fit_temperature(dprob(spark, d), dtruth(spark, d), [0.5, 1.0, 2.0, 4.0]).select("t", *rnd("log_loss"))


@query(
    "md_14_select_view",
    """WITH g AS (SELECT unnest([1, 5, 10]) AS k), w AS (SELECT unnest([1.0::DOUBLE, 4.0::DOUBLE]) AS power), t AS (SELECT 'dense' AS view, q_id, class, rank, sim FROM v_dn WHERE sim > 0 UNION ALL SELECT 'square', q_id, class, rank, sim * sim FROM v_dn WHERE sim > 0),
    v AS (SELECT view, k, power, q_id, class, round(sum(pow(sim, power)), 9) AS v FROM t, g, w WHERE rank <= k GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY view, k, power, q_id ORDER BY v DESC, class) AS n FROM v)
    SELECT view, CAST(k AS INTEGER) AS k, power, count(*) AS n, round(avg(CASE WHEN class = label THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS accuracy FROM b JOIN v_dense d ON d.id = b.q_id WHERE n = 1 GROUP BY view, k, power""",
)
def md_14(spark, d):
    n = dn(spark, d).where(F.col("sim") > 0)
    return D.select_view({"dense": n, "square": n.withColumn("sim", F.col("sim") * F.col("sim"))}, dtruth(spark, d), [1, 5, 10], [1, 4])


@query("md_15_promotion_gate", "SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, round(bar, 6) AS bar, val_accuracy >= bar AS promote FROM (SELECT *, greatest(0.85, coalesce(last_value(CASE WHEN status = 'promoted' THEN val_accuracy END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.01, 0.85)) AS bar FROM v_runs)")
def md_15(spark, d):
    return D.promotion_gate(S.runs(spark, d)).select(F.col("day").cast("string").alias("day"), *rnd("bar"), "promote")


@query("md_16_fail_safe", "SELECT id, auto AND id % 10 <> 0 AS auto FROM v_pred")
def md_16(spark, d):
    p = S.predictions(spark, d)
    return D.fail_safe(p.select("id", "auto"), p.where(F.col("id") % 10 != 0))
