"""Queries of sources, splits, deduplication, windows and set operations (SC, SP, DD, WN, SO, SU)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textengine.operators import relational as R
from textengine.operators import split as P
from textengine.sources import io as IO

from . import views as S
from .registry import VIEWS, query

HASH = "md5(concat(CAST(id AS VARCHAR), '-{0}'))"


def docs(spark, d):
    return S.cleaned(spark, d)


@query("sc_01_read_tickets", "SELECT doc_id, source, lang FROM documents")
def sc_01(spark, d):
    return IO.read_table(spark, f"{d}/documents.parquet", ["doc_id", "source", "lang"])


@query("sc_02_read_jsonl", "SELECT id, text, queue FROM v_clean")
def sc_02(spark, d):
    rows = docs(spark, d).select("id", "text", "queue")
    return IO.read_jsonl(spark, IO.write_jsonl(rows, IO.scratch(spark, "jsonl")), rows.schema)


@query("sc_03_read_cache", "SELECT text AS source, max(queue) AS target FROM v_clean GROUP BY text")
def sc_03(spark, d):
    rows = docs(spark, d).groupBy(F.col("text").alias("source")).agg(F.max("queue").alias("target"), F.max("id").alias("seq"))
    path = IO.scratch(spark, "cache")
    IO.write_jsonl(rows, path)
    spark.range(1).select(F.lit('{"source": "cut off').alias("value")).write.mode("append").text(path)
    return IO.read_cache(spark, path).select("source", "target")


@query("sc_04_write_jsonl", "SELECT source, 2 * count(*) AS n FROM documents GROUP BY source")
def sc_04(spark, d):
    rows = S.table(spark, d, "documents").select("doc_id", "source")
    path = IO.write_jsonl(rows, IO.scratch(spark, "sink"))
    IO.write_jsonl(rows, path, "append")
    return IO.read_jsonl(spark, path, rows.schema).groupBy("source").agg(F.count("*").alias("n"))


@query("sc_05_read_results", "SELECT queue AS tier, round(avg(confidence), 4) AS accuracy, t.threshold, round(avg(CASE WHEN confidence >= t.threshold THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS coverage FROM v_pred, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE]) AS threshold) t GROUP BY queue, t.threshold")
def sc_05(spark, d):
    p = S.predictions(spark, d)
    cuts = F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(F.avg((F.col("confidence") >= t).cast("double")), 4).alias("coverage")) for t in (0.5, 0.7)])
    results = p.groupBy(F.col("queue").alias("tier")).agg(F.round(F.avg("confidence"), 4).alias("accuracy"), cuts.alias("thresholds"))
    path = IO.write_jsonl(results, IO.scratch(spark, "results"))
    return IO.read_results(spark, path, results.schema).select("tier", "accuracy", F.inline("thresholds"))


@query("sc_06_append_predictions", "SELECT CAST(created_at AS DATE)::VARCHAR AS day, 2 * count(*) AS n FROM v_pred GROUP BY 1")
def sc_06(spark, d):
    path = IO.scratch(spark, "audit")
    p = S.predictions(spark, d)
    IO.append_rows(p, path, "created_at")
    IO.append_rows(p, path, "created_at")
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("sc_07_append_feedback", "SELECT 'feedback' AS kind, count(*) AS n FROM v_fb UNION ALL SELECT 'runs', count(*) FROM v_runs")
def sc_07(spark, d):
    a, b = IO.scratch(spark, "feedback"), IO.scratch(spark, "runs")
    IO.append_rows(S.feedback(spark, d), a, "created_at")
    S.runs(spark, d).write.mode("append").parquet(b)
    count = lambda p, k: spark.read.parquet(p).agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return count(a, "feedback").union(count(b, "runs"))


@query("sc_08_latest_version", "SELECT arg_max(model_version, day) AS model_version, round(arg_max(val_accuracy, day), 6) AS val_accuracy FROM v_runs WHERE status = 'promoted'")
def sc_08(spark, d):
    return IO.latest_version(S.runs(spark, d)).select("model_version", F.round("val_accuracy", 6).alias("val_accuracy"))


@query(
    "sc_09_fingerprint",
    "SELECT queue, left(sha256(concat_ws('|', count(*), CAST(sum(r) AS VARCHAR), bit_xor(r))), 16) AS fingerprint FROM (SELECT queue, CAST('0x' || left(sha256(concat_ws('|', CAST(id AS VARCHAR), text)), 15) AS BIGINT) AS r FROM v_clean) GROUP BY queue",
)
def sc_09(spark, d):
    return IO.fingerprint(docs(spark, d), ["id", "text"], "queue")


@query("sc_10_table_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events")
def sc_10(spark, d):
    return IO.table_counts({n: S.table(spark, d, n) for n in ("documents", "labels", "events")})


@query("dd_01_dedup_first", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY text ORDER BY id) AS n FROM v_clean) WHERE n = 1")
def dd_01(spark, d):
    return P.dedup_first(docs(spark, d), "text").select("id")


@query("dd_02_anti_text", "SELECT id FROM v_clean WHERE queue <> 'src0' AND text NOT IN (SELECT text FROM v_clean WHERE queue = 'src0')")
def dd_02(spark, d):
    rows = docs(spark, d)
    return P.anti_text(rows.where(F.col("queue") != "src0"), rows.where(F.col("queue") == "src0")).select("id")


def close_pairs(spark, d, low: float = 0.3):
    from . import neighbours as N

    w = N.all_blocks(spark, d)
    from textengine.operators.similarity import sim_join

    return sim_join(w, w, low, 2.0, same=True)


@query(
    "dd_03_greedy_dedup",
    """WITH e AS (SELECT n_id AS id, list(q_id) AS earlier FROM v_loo_all WHERE q_id < n_id AND sim >= 0.85 GROUP BY n_id),
    d AS (SELECT list_reduce(list(struct_pack(id := id, earlier := earlier, gone := CAST([] AS BIGINT[])) ORDER BY id), lambda a, x: struct_pack(id := x.id, earlier := x.earlier,
     gone := CASE WHEN len(list_filter(x.earlier, lambda y: NOT list_contains(a.gone, y))) > 0 THEN list_append(a.gone, x.id) ELSE a.gone END), struct_pack(id := CAST(-1 AS BIGINT), earlier := CAST([] AS BIGINT[]), gone := CAST([] AS BIGINT[]))) AS r FROM e)
    SELECT id FROM v_clean WHERE id NOT IN (SELECT unnest(r.gone) FROM d)""",
)
def dd_03(spark, d):
    return P.greedy_dedup(docs(spark, d), close_pairs(spark, d, 0.85)).select("id")


@query("dd_04_drop_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN g.sparse >= 0.3 THEN 'near_test' WHEN length(c.text) < 100 THEN 'short' WHEN c.queue = 'src1' THEN 'copies_seed' ELSE 'kept' END AS reason FROM v_clean c LEFT JOIN v_guard g ON g.id = c.id) GROUP BY reason")
def dd_04(spark, d):
    from . import neighbours as N

    rows = docs(spark, d).join(N.guard(spark, d), "id", "left")
    return P.drop_reasons(rows, {"near_test": F.col("sparse") >= 0.3, "short": F.length("text") < 100, "copies_seed": F.col("queue") == "src1"}).groupBy("reason").agg(F.count("*").alias("n"))


@query("dd_05_filter_siblings", "SELECT id, CASE WHEN reason = 'kept' AND n > 1 THEN 'duplicate' ELSE reason END AS reason FROM (SELECT id, reason, row_number() OVER (PARTITION BY reason, text ORDER BY id) AS n FROM (SELECT c.id, c.text, CASE WHEN l.sim >= 0.92 THEN 'copy' WHEN l.sim < 0.15 THEN 'drifted' ELSE 'kept' END AS reason FROM v_clean c JOIN v_loo_all l ON l.q_id = c.id AND l.rank = 1))")
def dd_05(spark, d):
    from . import neighbours as N

    sims = N.loo_topk(spark, d, 1).select(F.col("q_id").alias("id"), "sim")
    return P.filter_siblings(docs(spark, d).join(sims, "id")).select("id", "reason")


def _order(by: str, seed: int) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {HASH.format(seed)}, id)"


@query("sp_01_stratified_split", f"SELECT id, CASE WHEN p <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (SELECT id, {_order('queue', 42)} AS p, count(*) OVER (PARTITION BY queue) AS n FROM v_clean)")
def sp_01(spark, d):
    return P.stratified_split(docs(spark, d), "queue", 0.2, 42).select("id", "split")


@query("sp_02_carve_validation", f"SELECT id, CASE WHEN p <= round(n * 0.15) THEN 'test' ELSE 'train' END AS split FROM (SELECT id, {_order('queue', 7)} AS p, count(*) OVER (PARTITION BY queue) AS n FROM v_en)")
def sp_02(spark, d):
    return P.stratified_split(S.pool_en(spark, d), "queue", 0.15, 7).select("id", "split")


@query("sp_03_assign_folds", f"SELECT id, CAST(({_order('queue', 42)} - 1) % 5 AS INTEGER) AS fold FROM v_clean")
def sp_03(spark, d):
    return P.assign_folds(docs(spark, d), "queue", 5, 42).select("id", "fold")


@query("sp_04_nested_folds", f"SELECT id, outer_fold, CAST((row_number() OVER (PARTITION BY queue, outer_fold ORDER BY {HASH.format(43)}, id) - 1) % 3 AS INTEGER) AS inner_fold FROM (SELECT id, queue, CAST(({_order('queue', 42)} - 1) % 5 AS INTEGER) AS outer_fold FROM v_clean)")
def sp_04(spark, d):
    return P.nested_folds(docs(spark, d), "queue", 5, 3, 42).select("id", "outer_fold", "inner_fold")


@query("sp_05_stratified_subset", f"SELECT id, queue FROM (SELECT id, queue, {_order('queue', 5)} AS p, count(*) OVER (PARTITION BY queue) AS nc, count(*) OVER () AS n FROM v_clean) WHERE p <= round(300 * nc / n::DOUBLE)")
def sp_05(spark, d):
    return P.stratified_subset(docs(spark, d), "queue", 300, 5).select("id", "queue")


@query("sp_06_growing_pools", f"SELECT frac, count(*) AS n FROM (SELECT {_order('queue', 3)} / count(*) OVER (PARTITION BY queue)::DOUBLE AS u FROM v_clean), (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS frac) WHERE u <= frac GROUP BY frac")
def sp_06(spark, d):
    return P.growing_pools(docs(spark, d), (0.25, 0.5, 1.0), 3, "queue").groupBy("frac").agg(F.count("*").alias("n"))


@query("sp_07_cap_per_class", f"SELECT id, queue FROM (SELECT id, queue, {_order('queue', 11)} AS p FROM v_clean) WHERE p <= 7")
def sp_07(spark, d):
    return P.cap_per_class(docs(spark, d), "queue", 7, 11).select("id", "queue")


@query("sp_08_shuffle_labels", f"SELECT a.id, b.queue AS shuffled FROM (SELECT id, row_number() OVER (ORDER BY {HASH.format(1)}, id) AS i FROM v_clean) a JOIN (SELECT queue, row_number() OVER (ORDER BY {HASH.format(2)}, id) AS i FROM v_clean) b USING (i)")
def sp_08(spark, d):
    return P.shuffle_labels(docs(spark, d), "queue", 1).select("id", "shuffled")


@query("sp_09_sample_n", f"SELECT id FROM v_clean ORDER BY {HASH.format(9)}, id LIMIT 100")
def sp_09(spark, d):
    return P.sample_n(docs(spark, d), 100, 9).select("id")


@query("wn_01_rank_within", "SELECT id, CAST(row_number() OVER (PARTITION BY queue ORDER BY confidence DESC, id) AS INTEGER) AS place, CAST(rank() OVER (PARTITION BY queue ORDER BY confidence DESC, id) AS INTEGER) AS rank FROM v_pred")
def wn_01(spark, d):
    return R.rank_within(S.predictions(spark, d), "queue", [F.desc("confidence"), F.col("id")]).select("id", "place", "rank")


@query("wn_02_gap", "SELECT id, round(confidence - CASE WHEN confidence >= m[1] THEN m[2] ELSE m[1] END, 6) AS gap FROM v_pred JOIN (SELECT api_key, list_sort(list(confidence), 'DESC') AS m FROM v_pred GROUP BY api_key) USING (api_key) WHERE len(m) > 1")
def wn_02(spark, d):
    from textengine.operators.evidence import gap

    p = S.predictions(spark, d).withColumn("n", F.count("*").over(R.W.partitionBy("api_key"))).where(F.col("n") > 1)
    return gap(p, "api_key", "confidence", "gap").select("id", F.round("gap", 6).alias("gap"))


@query("wn_03_rate_flags", "SELECT id, n, n > 1 AS over FROM (SELECT id, count(*) OVER (PARTITION BY api_key ORDER BY CAST(floor(epoch(created_at)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM v_pred)")
def wn_03(spark, d):
    return R.rate_flags(S.predictions(spark, d), 1, 3600).select("id", "n", "over")


@query("wn_04_latest_per", "SELECT api_key, arg_max(id, (created_at, id)) AS id, arg_max(queue, (created_at, id)) AS queue FROM v_pred GROUP BY api_key")
def wn_04(spark, d):
    return R.latest_per(S.predictions(spark, d).select("api_key", "created_at", "id", "queue"), "api_key", "created_at", "id").select("api_key", "id", "queue")


@query("wn_05_fractions", "SELECT id, round(percent_rank() OVER (ORDER BY confidence), 6) AS pct, CAST(ntile(10) OVER (ORDER BY confidence, id) AS INTEGER) AS tile FROM v_pred")
def wn_05(spark, d):
    return R.fractions(S.predictions(spark, d), "confidence", 10).select("id", F.round("pct", 6).alias("pct"), "tile")


@query("so_01_newest", "SELECT id, created_at FROM v_pred ORDER BY created_at DESC, id LIMIT 500")
def so_01(spark, d):
    return R.newest(S.predictions(spark, d), 500).select("id", "created_at")


@query("so_02_topk", "SELECT id, queue, CAST(place AS INTEGER) AS place FROM (SELECT id, queue, row_number() OVER (PARTITION BY queue ORDER BY confidence, id) AS place FROM v_pred) WHERE place <= 12")
def so_02(spark, d):
    return R.topk(S.predictions(spark, d), "queue", 12, [F.col("confidence"), F.col("id")]).select("id", "queue", "place")


@query("su_01_union_pools", "SELECT pool, count(*) AS n FROM (SELECT 'en' AS pool, id FROM v_en UNION ALL SELECT 'xx', id FROM v_xx UNION ALL SELECT 'eval', id FROM v_eval) GROUP BY pool")
def su_01(spark, d):
    return R.union_pools(en=S.pool_en(spark, d), xx=S.pool_xx(spark, d), eval=S.evals(spark, d)).groupBy("pool").agg(F.count("*").alias("n"))


@query("su_02_overlap", "SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (SELECT text, bool_or(id % 2 = 0) AS a, bool_or(id % 2 = 1) AS b FROM v_clean GROUP BY text)")
def su_02(spark, d):
    rows = docs(spark, d)
    return R.overlap(rows.where(F.col("id") % 2 == 0), rows.where(F.col("id") % 2 == 1))
