"""Queries of evaluation and families (EV, FM)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F



from textengine.operators import blocks as B
from textengine.operators import chunks as C
from textengine.operators import families as M
from textengine.operators import metrics as V
from textengine.operators import similarity as J
from textengine.sources import io as IO

from . import neighbours as N
from . import views as S
from .registry import VIEWS, query
from .text import SENTENCES

OK = "CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0.0 END"
VIEWS["v_counts"] = "SELECT c.class, (SELECT count(*) FROM v_dpred WHERE y = c.class) AS n, (SELECT count(*) FROM v_dpred WHERE y = c.class AND pred = c.class) AS tp, (SELECT count(*) FROM v_dpred WHERE pred = c.class) AS predicted FROM (SELECT y AS class FROM v_dpred UNION SELECT pred FROM v_dpred) c"
VIEWS["v_dpred2"] = "SELECT p.q_id, p.y, n.class AS pred, p.conf, p.sim FROM v_dpred p JOIN v_dn n ON n.q_id = p.q_id AND n.rank = 1"


def preds(spark, d):
    return N.dpred(spark, d)


def nn_preds(spark, d):
    p = preds(spark, d).drop("pred")
    return p.join(N.dn(spark, d, 1).select("q_id", F.col("class").alias("pred")), "q_id")


def truth(spark, d):
    return N.dtruth(spark, d)


@query("ev_01_accuracy", f"SELECT count(*) AS n, round(avg({OK}), 4) AS accuracy FROM v_dpred")
def ev_01(spark, d):
    return V.accuracy(preds(spark, d))


@query("ev_02_macro_f1", "SELECT round(avg(2 * tp / (n + predicted)::DOUBLE), 4) AS macro_f1, count(*) AS classes FROM v_counts")
def ev_02(spark, d):
    return V.macro_f1(preds(spark, d))


@query("ev_03_per_class_report", "SELECT class, n, CASE WHEN n > 0 THEN round(tp / n::DOUBLE, 4) END AS recall, CASE WHEN predicted > 0 THEN round(tp / predicted::DOUBLE, 4) END AS precision, predicted FROM v_counts")
def ev_03(spark, d):
    return V.per_class_report(preds(spark, d))


@query("ev_04_confusion_pairs", "SELECT y, pred, count(*) AS n FROM v_dpred WHERE pred <> y GROUP BY y, pred ORDER BY n DESC, y, pred LIMIT 8")
def ev_04(spark, d):
    return V.confusion_pairs(preds(spark, d), 8)


@query("ev_05_threshold_table", f"SELECT t.threshold, round(avg(CASE WHEN conf >= threshold THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS coverage, round(avg({OK}) FILTER (conf >= threshold), 4) AS accuracy_on_routed, round(1 - avg(CASE WHEN conf >= threshold THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS sent_to_human FROM v_dpred, (SELECT unnest([0.0::DOUBLE, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]) AS threshold) t GROUP BY t.threshold")
def ev_05(spark, d):
    return V.threshold_table(preds(spark, d))


@query("ev_06_ece", f"SELECT round(sum(n / (SELECT count(*) FROM v_dpred)::DOUBLE * abs(c - a)), 4) AS ece FROM (SELECT ceil(conf * 15) AS bin, count(*) AS n, avg(conf) AS c, avg({OK}) AS a FROM v_dpred WHERE conf > 0 GROUP BY 1)")
def ev_06(spark, d):
    return V.ece(preds(spark, d))


BAND = f"SELECT b.low, b.high, count(p.q_id) AS n, round(count(p.q_id) / (SELECT count(*) FROM v_dpred)::DOUBLE, 4) AS share, round(avg(CASE WHEN p.q_id IS NOT NULL THEN {OK} END), 4) AS accuracy_pred FROM v_bands b LEFT JOIN v_dpred p ON p.{{0}} >= b.low AND p.{{0}} < b.high GROUP BY b.low, b.high"


@query("ev_07_band_table", BAND.format("sim"))
def ev_07(spark, d):
    return V.band_table(preds(spark, d), N.BANDS)


@query("ev_08_slice_accuracy", f"SELECT count(*) FILTER (sim >= 0.5) AS n_familiar, count(*) FILTER (sim < 0.5) AS n_unfamiliar, round(avg({OK}) FILTER (sim >= 0.5), 4) AS accuracy_familiar, round(avg({OK}) FILTER (sim < 0.5), 4) AS accuracy_unfamiliar FROM v_dpred")
def ev_08(spark, d):
    return V.slice_accuracy(preds(spark, d), {"familiar": F.col("sim") >= 0.5, "unfamiliar": F.col("sim") < 0.5})


VIEWS["v_trank"] = "SELECT q_id, r, p FROM (SELECT p.*, row_number() OVER (PARTITION BY q_id ORDER BY round(p, 9) DESC, class) AS r FROM v_dprob p) x JOIN v_dense d ON d.id = x.q_id AND d.label = x.class"


@query("ev_09_topk_hit_rate", "SELECT round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS top1, round(avg(CASE WHEN r <= 2 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS top2, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS top3 FROM (SELECT DISTINCT q_id FROM v_dprob) LEFT JOIN v_trank USING (q_id)")
def ev_09(spark, d):
    return V.topk_hit_rate(N.dprob(spark, d), truth(spark, d))


@query("ev_10_log_loss", "SELECT round(avg(-ln(greatest(coalesce(t.p, 0.0), 1e-6))), 4) AS log_loss, round(avg(most), 4) AS mean_max, round(avg(squares), 4) AS mean_squares FROM (SELECT q_id, max(p) AS most, sum(p * p) AS squares FROM v_dprob GROUP BY q_id) q LEFT JOIN v_trank t USING (q_id)")
def ev_10(spark, d):
    return V.log_loss(N.dprob(spark, d), truth(spark, d))


@query("ev_11_confidence_slices", BAND.format("conf"))
def ev_11(spark, d):
    return V.band_table(preds(spark, d), N.BANDS, "conf")


#: The draws of the operator, in SQL.
_U = "((CAST('0x' || left(md5(concat_ws('|', '0', CAST(y AS VARCHAR), CAST(pa AS VARCHAR), CAST(pb AS VARCHAR), CAST(rep AS VARCHAR), {})), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
_POISSON = " + ".join(f"CASE WHEN {e!r}::DOUBLE < u THEN 1 ELSE 0 END" for e in V.poisson_edges())
VIEWS["v_resampled"] = f"""SELECT c.rep, c.y, c.pa, c.pb, CASE WHEN any_value(m) <= {V.SMALL_CELL} THEN sum({_POISSON})::DOUBLE ELSE greatest(floor(any_value(m) + sqrt(any_value(m)) * any_value(z) + (any_value(z) * any_value(z) - 1) / 6 + 0.5::DOUBLE), 0.0) END AS w
 FROM (SELECT *, {_U.format("CAST(i AS VARCHAR)")} AS u, sqrt(-2 * ln({_U.format("'r'")})) * cos({2 * math.pi!r}::DOUBLE * {_U.format("'a'")}) AS z FROM (SELECT *, unnest(range(1, least(m, {V.SMALL_CELL}) + 1)) AS i FROM
 (SELECT a.y, a.pred AS pa, b.pred AS pb, count(*) AS m FROM v_dpred2 a JOIN v_dpred b USING (q_id) GROUP BY a.y, a.pred, b.pred) CROSS JOIN (SELECT unnest(range(1, 3001)) AS rep))) c GROUP BY c.rep, c.y, c.pa, c.pb"""
_INTERVAL = """SELECT '{0}' AS measure, count(gain) AS resamples, round(avg(gain), 4) AS gain, round(quantile_cont(gain, 0.025), 4) AS low, round(quantile_cont(gain, 0.975), 4) AS high,
 CASE WHEN round(quantile_cont(gain, 0.025), 4) > 0 THEN 'better' WHEN round(quantile_cont(gain, 0.975), 4) < 0 THEN 'worse' ELSE 'no difference' END AS verdict FROM {1}"""


@query(
    "ev_12_paired_bootstrap",
    """WITH g AS (SELECT rep, sum(CASE WHEN pb = y THEN w ELSE 0 END - CASE WHEN pa = y THEN w ELSE 0 END) / nullif(sum(w), 0) AS gain FROM v_resampled GROUP BY rep),
    k AS (SELECT rep, class, sum(t) AS t, sum(a) AS a, sum(b) AS b, sum(ha) AS ha, sum(hb) AS hb FROM (
      SELECT rep, y AS class, w AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, CASE WHEN pa = y THEN w ELSE 0.0::DOUBLE END AS ha, CASE WHEN pb = y THEN w ELSE 0.0::DOUBLE END AS hb FROM v_resampled WHERE rep <= 1000
      UNION ALL SELECT rep, pa, 0, w, 0, 0, 0 FROM v_resampled WHERE rep <= 1000 UNION ALL SELECT rep, pb, 0, 0, w, 0, 0 FROM v_resampled WHERE rep <= 1000) GROUP BY rep, class),
    f AS (SELECT rep, avg(2 * hb / nullif(t + b, 0)) - avg(2 * ha / nullif(t + a, 0)) AS gain FROM k GROUP BY rep)
    """
    + _INTERVAL.format("accuracy", "g")
    + " UNION ALL "
    + _INTERVAL.format("macro_f1", "f"),
)
def ev_12(spark, d):
    return V.paired_bootstrap(nn_preds(spark, d), preds(spark, d))


@query("ev_13_mean_sd", "SELECT queue, round(avg(confidence), 4) AS mean, round(stddev_pop(confidence), 4) AS sd, count(*) AS runs FROM v_pred GROUP BY queue")
def ev_13(spark, d):
    return V.mean_sd(S.predictions(spark, d), "queue", "confidence")


@query("ev_14_sim_quantiles", "SELECT round(quantile_cont(sim, 0.1), 6) AS q10, round(quantile_cont(sim, 0.5), 6) AS q50, round(quantile_cont(sim, 0.9), 6) AS q90 FROM v_dn WHERE rank = 1")
def ev_14(spark, d):
    return V.quantiles(N.dn(spark, d, 1), "sim", (0.1, 0.5, 0.9))


@query("ev_15_pool_curve", "WITH r AS (SELECT f.frac, n.q_id, arg_max(d.label, (n.sim, -n.n_id)) AS pred, max(n.sim) AS sim FROM v_dn_all n JOIN v_dense d ON d.id = n.n_id, (SELECT unnest([0.25::DOUBLE, 0.5, 1.0]) AS frac) f WHERE n.rank <= 400 AND (n.n_id % 100) / 100.0::DOUBLE < f.frac GROUP BY f.frac, n.q_id) SELECT frac, count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS accuracy, round(avg(CASE WHEN sim >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS familiar FROM r JOIN v_dense t ON t.id = r.q_id GROUP BY frac")
def ev_15(spark, d):
    n = N.dn(spark, d, 400)
    place = S.dense(spark, d).select(F.col("id").alias("n_id"), ((F.col("id") % 100) / 100).alias("u"))
    return V.pool_curve(n, truth(spark, d), place, (0.25, 0.5, 1.0))


@query("ev_16_neighbour_purity", "SELECT CAST(rank AS INTEGER) AS rank, count(*) AS n, round(avg(CASE WHEN class = label THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS same FROM v_dn JOIN v_dense d ON d.id = q_id GROUP BY rank")
def ev_16(spark, d):
    return V.neighbour_purity(N.dn(spark, d), truth(spark, d))


@query("ev_16_chance_rate", "SELECT round(sum(s * s), 6) AS chance FROM (SELECT count(*) / (SELECT count(*) FROM v_dense)::DOUBLE AS s FROM v_dense GROUP BY label)")
def ev_16c(spark, d):
    return V.chance_rate(S.dense(spark, d), "label")


@query("ev_17_family_fraction", "WITH b AS (SELECT low, count(*) / (SELECT count(*) FROM v_dn WHERE rank = 1)::DOUBLE AS share, avg(CASE WHEN class = label THEN 1.0::DOUBLE ELSE 0.0 END) AS same FROM v_dn JOIN v_dense d ON d.id = q_id JOIN v_bands ON sim >= low AND sim < high WHERE rank = 1 GROUP BY low), p AS (SELECT *, greatest(0.0, least(1.0, (same - 0.1) / (1 - 0.1))) AS pi FROM b) SELECT low, round(pi, 4) AS pi, round(share * (pi * 0.995 + (1 - pi) * 0.40), 4) AS ceiling FROM p")
def ev_17(spark, d):
    rows = J.in_bands(N.dn(spark, d, 1).join(truth(spark, d), "q_id"), "sim", N.BANDS)
    total = V.W.partitionBy()
    cells = rows.groupBy("low").agg(F.count("*").alias("n"), F.avg((F.col("class") == F.col("y")).cast("double")).alias("same"))
    return V.family_fraction(cells.withColumn("share", F.col("n") / F.sum("n").over(total)), 0.1).select("low", "pi", "ceiling")


@query("ev_18_sibling_report", "WITH q AS (SELECT q_id, bool_or(class = label) AS a, bool_or(class = label AND rank = 1) AS f FROM v_dn JOIN v_dense d ON d.id = q_id WHERE rank <= 20 GROUP BY q_id) SELECT count(*) AS n, round(avg(a::INT::DOUBLE), 4) AS in_top, round(avg(f::INT::DOUBLE), 4) AS at_first, round(avg(f::INT::DOUBLE) FILTER (a), 4) AS accuracy_with FROM q")
def ev_18(spark, d):
    return V.sibling_report(N.dn(spark, d), truth(spark, d), 20)


@query("ev_19_view_oracle", "SELECT round(avg((a.pred = a.y OR b.pred = a.y)::INT::DOUBLE), 4) AS any, round(avg((a.pred = a.y AND b.pred = a.y)::INT::DOUBLE), 4) AS all, round(avg((a.pred = b.pred)::INT::DOUBLE), 4) AS same FROM v_dpred a JOIN v_dpred2 b USING (q_id)")
def ev_19(spark, d):
    return V.view_oracle([preds(spark, d), nn_preds(spark, d)])


@query("ev_20_segment_report", f"SELECT segment, count(*) AS n, round(avg({OK}), 4) AS accuracy FROM (SELECT *, q_id % 4 AS segment FROM v_dpred) GROUP BY ROLLUP (segment)")
def ev_20(spark, d):
    return V.segment_report(preds(spark, d).withColumn("segment", F.col("q_id") % 4), "segment")


@query("ev_21_label_mix", "SELECT language, queue, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_tickets x WHERE x.language = t.language)::DOUBLE, 6) AS share, round((SELECT count(*) FROM v_tickets x WHERE x.queue = t.queue) / (SELECT count(*) FROM v_tickets)::DOUBLE, 6) AS prior FROM v_tickets t GROUP BY language, queue")
def ev_21(spark, d):
    return V.label_mix(S.tickets(spark, d), "language", "queue")


@query("ev_22_gain_loss", "SELECT CASE WHEN a.pred = a.y AND b.pred <> a.y THEN 'fixed' WHEN a.pred <> a.y AND b.pred = a.y THEN 'broken' ELSE 'same' END AS kind, count(*) AS n, round(quantile_cont(a.sim, 0.25), 6) AS q25, round(quantile_cont(a.sim, 0.5), 6) AS q50, round(quantile_cont(a.sim, 0.75), 6) AS q75 FROM v_dpred a JOIN v_dpred2 b USING (q_id) GROUP BY 1")
def ev_22(spark, d):
    return V.gain_loss(preds(spark, d), nn_preds(spark, d))


@query("ev_23_tier_report", "SELECT queue AS tier, round(avg(confidence), 4) AS accuracy, count(*) / 60.0::DOUBLE AS minutes, t.threshold, round(avg(CASE WHEN confidence >= threshold THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS coverage FROM v_pred, (SELECT unnest([0.0::DOUBLE, 0.5, 0.7, 0.9]) AS threshold) t GROUP BY queue, t.threshold")
def ev_23(spark, d):
    cuts = F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(F.avg((F.col("confidence") >= t).cast("double")), 4).alias("coverage")) for t in (0.0, 0.5, 0.7, 0.9)])
    seconds = F.count("*").cast("double")
    rows = S.predictions(spark, d).groupBy(F.col("queue").alias("tier")).agg(F.round(F.avg("confidence"), 4).alias("accuracy"), seconds.alias("train_seconds"), F.lit(None).cast("double").alias("train_minutes"), cuts.alias("thresholds"))
    rows = IO.read_results(spark, IO.write_jsonl(rows, IO.scratch(spark, "tiers")), rows.schema)
    return rows.select("tier", "accuracy", F.coalesce(F.col("train_seconds") / 60, "train_minutes").alias("minutes"), F.inline("thresholds"))


@query("ev_24_runs_count", "SELECT status, count(*) AS n FROM v_runs GROUP BY status")
def ev_24(spark, d):
    return S.runs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("ev_25_realism", "SELECT round(quantile_cont(x.sim, 0.5), 6) AS median_sim, round(avg(CASE WHEN n.class = c.queue THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS label_fit FROM (SELECT q_id, sim FROM v_near_all WHERE rank = 1) x JOIN v_near n ON n.q_id = x.q_id AND n.rank = 1 JOIN v_clean c ON c.id = x.q_id")
def ev_25(spark, d):
    n = N.near(spark, d, 1).join(N.docs(spark, d).select(F.col("id").alias("q_id"), "queue"), "q_id")
    return n.agg(F.round(F.percentile("sim", 0.5), 6).alias("median_sim"), F.round(F.avg((F.col("class") == F.col("queue")).cast("double")), 4).alias("label_fit"))


@query("ev_26_provenance", "SELECT count(*) AS n, count(*) FILTER (language <> 'en') AS wrong_language, count(*) FILTER (queue NOT LIKE 'src%') AS wrong_queue, count(DISTINCT text) AS texts FROM v_clean")
def ev_26(spark, d):
    return N.docs(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("language") != "en").alias("wrong_language"), F.count_if(~F.col("queue").like("src%")).alias("wrong_queue"), F.countDistinct("text").alias("texts"))


@query("ev_27_exceedance", "SELECT cut, count(*) FILTER (sim >= cut) AS n, round(avg(CASE WHEN class = label THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (sim >= cut), 4) AS same FROM v_dn JOIN v_dense d ON d.id = q_id, (SELECT unnest([0.9::DOUBLE, 0.5, 0.4, 0.3]) AS cut) c WHERE rank = 1 GROUP BY cut")
def ev_27(spark, d):
    return V.exceedance(N.dn(spark, d, 1), truth(spark, d), (0.9, 0.5, 0.4, 0.3))


@query("ev_28_embedding_check", "SELECT count(*) AS n, 1.0::DOUBLE AS least, 1.0::DOUBLE AS mean, bool_and(abs(sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) - 1) < 1e-3) AS unit FROM v_dense")
def ev_28(spark, d):
    return V.embedding_check(S.dense(spark, d), S.dense(spark, d))


@query("ev_29_parity", "WITH b AS (SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.class, b.class) AS class, coalesce(a.p, 0.0) AS pa, coalesce(b.p, 0.0) AS pb FROM v_dprob a FULL JOIN v_dprob2 b ON a.q_id = b.q_id AND a.class = b.class) SELECT round(max(m), 6) AS max_diff, round(avg(s::INT::DOUBLE), 4) AS agreement FROM (SELECT q_id, max(abs(pa - pb)) AS m, arg_max(class, (round(pa, 9), class)) = arg_max(class, (round(pb, 9), class)) AS s FROM b GROUP BY q_id)")
def ev_29(spark, d):
    return V.parity(N.dprob(spark, d), N.dprob(spark, d, 20, 1))


@query("ev_30_cross_family_rate", "SELECT low, a.language IS NOT DISTINCT FROM b.language AS same_meta, count(*) AS n, round(avg(CASE WHEN a.queue = b.queue THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS same FROM v_loo n JOIN v_clean a ON a.id = n.q_id JOIN v_clean b ON b.id = n.n_id JOIN v_bands ON sim >= low AND sim < high GROUP BY 1, 2")
def ev_30(spark, d):
    return V.cross_family_rate(N.loo(spark, d).select("q_id", "n_id", "sim"), N.docs(spark, d), "queue", ("language",), N.BANDS)


@query("ev_32_config_report", f"SELECT config, round(avg({OK}) FILTER (sim < 0.4), 4) AS low, round(avg({OK}) FILTER (sim >= 0.4), 4) AS high FROM (SELECT 'vote' AS config, * FROM v_dpred UNION ALL SELECT 'nn', * FROM v_dpred2) GROUP BY config")
def ev_32(spark, d):
    cols = ["q_id", "y", "pred", "sim"]
    rows = preds(spark, d).select(F.lit("vote").alias("config"), *cols).union(nn_preds(spark, d).select(F.lit("nn"), *cols))
    return rows.groupBy("config").agg(F.round(F.avg(F.when(F.col("sim") < 0.4, V.right())), 4).alias("low"), F.round(F.avg(F.when(F.col("sim") >= 0.4, V.right())), 4).alias("high"))


@query("ev_33_accuracy_with_missing", f"SELECT round(avg(CASE WHEN q_id % 3 = 0 THEN 0.0 ELSE {OK} END), 4) AS accuracy, count(*) FILTER (q_id % 3 = 0) AS missing, round(avg({OK}) FILTER (q_id % 3 <> 0), 4) AS accuracy_parsed FROM v_dpred")
def ev_33(spark, d):
    return V.with_missing(preds(spark, d).withColumn("pred", F.when(F.col("q_id") % 3 != 0, F.col("pred"))))


def edges(spark, d, low: float):
    w = N.all_blocks(spark, d)
    return J.sim_join(w, w, low, 2.0, same=True)


FAMILY = """WITH RECURSIVE e AS MATERIALIZED (SELECT q_id AS a, n_id AS b FROM v_loo_all WHERE sim >= {0} {1}), r(id, root) AS (SELECT id, id FROM v_clean UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.id),
 f AS (SELECT id, min(root) AS family FROM r GROUP BY id) SELECT id, family, count(*) OVER (PARTITION BY family) AS size FROM f"""


@query("fm_01_families", FAMILY.format("0.5", ""))
def fm_01(spark, d):
    return M.families(B.links(N.all_blocks(spark, d), 0.5, index=True), N.docs(spark, d))


@query("fm_02_constrained_families", FAMILY.format("0.45", "AND (SELECT language FROM v_clean x WHERE x.id = q_id) = (SELECT language FROM v_clean x WHERE x.id = n_id)"))
def fm_02(spark, d):
    # Rows of different languages share no term, and rows without one have no link.
    rows = C.term_chunks(N.docs(spark, d), by=F.coalesce(F.concat(F.lit("in "), "language"), F.lit("none")))
    e = B.links(C.own_blocks(rows, kept=F.col("by") != "none"), 0.45, index=True)
    return M.families(e, N.docs(spark, d))


@query(
    "fm_03_mine_pairs",
    FAMILY.format("0.3", "").split(" SELECT id, family, count(*)")[0]
    + """, m AS (SELECT id, family, count(*) OVER (PARTITION BY family) AS size FROM f), x AS (SELECT l.q_id AS a, l.n_id AS b, a.queue IS NOT DISTINCT FROM b.queue AND a.language IS NOT DISTINCT FROM b.language AS same
     FROM v_loo_all l JOIN v_clean a ON a.id = l.q_id JOIN v_clean b ON b.id = l.n_id WHERE l.q_id < l.n_id AND l.sim >= 0.3)
    SELECT a, b, CASE WHEN same THEN 'direct' ELSE 'negative' END AS kind FROM x UNION ALL SELECT p.id, q.id, 'transitive' FROM m p JOIN m q ON p.family = q.family AND p.id < q.id
     WHERE p.size BETWEEN 2 AND 60 AND NOT EXISTS (SELECT 1 FROM x WHERE x.a = p.id AND x.b = q.id AND x.same)""",
)
def fm_03(spark, d):
    e = edges(spark, d, 0.3)
    return M.mine_pairs(e, M.families(e, N.docs(spark, d)), N.docs(spark, d), ["queue", "language"], 0.3)


@query("fm_04_sibling_pairs", "SELECT q_id, n_id, sim, CASE WHEN q_id % 10 = 0 THEN 'held' ELSE 'train' END AS part FROM (SELECT l.q_id, l.n_id, l.sim, row_number() OVER (PARTITION BY l.q_id ORDER BY md5(concat(CAST(l.q_id AS VARCHAR), '-', CAST(l.n_id AS VARCHAR), '-7')), l.n_id) AS n FROM v_loo_all l JOIN v_clean a ON a.id = l.q_id JOIN v_clean b ON b.id = l.n_id WHERE a.queue = b.queue AND l.sim >= 0.4 AND l.sim < 0.85 AND length(a.text) <= 1100 AND length(b.text) <= 1100) WHERE n = 1")
def fm_04(spark, d):
    w = N.all_blocks(spark, d)
    one = J.sim_join(w, w, 0.4, 0.85, same=True).select("q_id", "n_id", "sim")
    both = one.union(one.select(F.col("n_id"), F.col("q_id"), "sim"))
    return M.sibling_pairs(both, N.docs(spark, d), 7, 0.4, 0.85, 1100)


@query("fm_05_triplets", "WITH r AS (SELECT l.*, a.queue AS y FROM v_loo l JOIN v_clean a ON a.id = l.q_id WHERE rank <= 10), p AS (SELECT q_id, n_id FROM r WHERE class = y AND sim >= 0.1), n AS (SELECT q_id, n_id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS k FROM r WHERE class <> y) WHERE k <= 5) SELECT p.q_id AS anchor, p.n_id AS positive, n.n_id AS negative FROM p JOIN n USING (q_id)")
def fm_05(spark, d):
    return M.triplets(N.loo(spark, d), N.docs(spark, d), 0.1)


@query("fm_06_error_report", "SELECT y, pred, count(*) AS n, string_agg(CAST(q_id AS VARCHAR), ' ' ORDER BY place) FILTER (place <= 12) AS seeds FROM (SELECT *, row_number() OVER (PARTITION BY y, pred ORDER BY round(conf, 9), q_id) AS place FROM v_dpred WHERE pred <> y) GROUP BY y, pred")
def fm_06(spark, d):
    texts = S.dense(spark, d).select("id", F.col("id").cast("string").alias("text"))
    rows = M.error_report(preds(spark, d), texts)
    return rows.select("y", "pred", "n", F.array_join(F.transform("seeds", lambda s: s["q_id"].cast("string")), " ").alias("seeds"))


@query("fm_07_allocate", "WITH b AS (SELECT y, count(*) FILTER (pred <> y) AS miss, count(*) AS n FROM v_dpred GROUP BY y), s AS (SELECT y, miss, round(0.7 * miss / sum(miss) OVER () + 0.3 * (miss / n::DOUBLE) / sum(miss / n::DOUBLE) OVER (), 9) AS share FROM b), r AS (SELECT *, floor(share * 1000) AS rows, row_number() OVER (ORDER BY share DESC, y) AS k FROM s) SELECT y, miss, CAST(rows + CASE WHEN k = 1 THEN 1000 - (SELECT sum(rows) FROM r) ELSE 0 END AS BIGINT) AS rows FROM r")
def fm_07(spark, d):
    return M.allocate(preds(spark, d), 1000)


@query("fm_08_targets", "WITH c AS (SELECT DISTINCT 'pair' AS kind, y FROM v_dpred WHERE pred <> y UNION SELECT DISTINCT 'weak', label FROM v_dense WHERE label < 3), s AS (SELECT label AS y, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM v_dense) WHERE n <= 5 GROUP BY label) SELECT c.kind, c.y, s.ids FROM c LEFT JOIN s USING (y)")
def fm_08(spark, d):
    weak = S.dense(spark, d).where(F.col("label") < 3).select(F.col("label").alias("y"))
    wrong = preds(spark, d).where(F.col("pred") != F.col("y"))
    return M.targets(wrong, weak, S.dense(spark, d), 5).select("kind", "y", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("fm_09_render_pairs", "SELECT id, concat('Write a ', queue, ' ticket in ', language, ' about: ', CASE WHEN instr(text, ' . ') > 0 THEN split_part(text, ' . ', 1) ELSE '' END) AS prompt, concat(' ', CASE WHEN instr(text, ' . ') > 0 THEN substring(text, instr(text, ' . ') + 3) ELSE text END) AS completion FROM v_clean")
def fm_09(spark, d):
    return M.render_pairs(N.docs(spark, d))


@query(
    "fm_10_translate_pool",
    f"""WITH s AS (SELECT id, unnest(s) AS source, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id AS id, {SENTENCES.format('text')} AS s FROM documents)), k AS (SELECT DISTINCT source FROM s WHERE id % 10 = 0)
    SELECT id, string_agg(CASE WHEN k.source IS NULL THEN lower(s.source) ELSE concat('<', s.source, '>') END, ' ' ORDER BY pos) AS text FROM s LEFT JOIN k ON k.source = s.source GROUP BY id""",
)
def fm_10(spark, d):
    rows = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    from textengine.functions.text import sentences

    known = rows.where(F.col("id") % 10 == 0).select(F.explode(sentences(F.col("text"))).alias("source")).distinct().select("source", F.concat(F.lit("<"), "source", F.lit(">")).alias("target"))
    return M.translate_pool(rows, known, lambda batch: [s.lower() for s in batch])



