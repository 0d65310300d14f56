"""Queries of corpus-level text features (TX)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textengine.functions import text as X
from textengine.operators import vectorize as V

from . import views as S
from .registry import VIEWS, query
from .text import lst

VIEWS["v_terms"] = r"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM v_clean) GROUP BY id, term"
VIEWS["v_idf"] = "SELECT term, ln((1 + (SELECT count(*) FROM v_clean)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM v_terms GROUP BY term HAVING count(*) >= 2"
VIEWS["v_tfidf"] = "SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, (1 + ln(tf)) * idf AS w FROM v_terms JOIN v_idf USING (term))"


def docs(spark, d):
    return S.cleaned(spark, d)


@query("tx_01_fit_vocab", "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM v_terms GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 5000")
def tx_01(spark, d):
    return V.fit_vocab(V.token_rows(docs(spark, d)), 2, cap=5000)


@query("tx_02_tfidf", "SELECT id, term, round(w, 6) AS w FROM v_tfidf")
def tx_02(spark, d):
    return V.tfidf_view(docs(spark, d)).select("id", "term", F.round("w", 6).alias("w"))


@query(
    "tx_03_tfidf_variants",
    r"""WITH g AS (SELECT id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT id, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS t FROM VCLEAN)),
    b AS (SELECT DISTINCT id, term FROM g), i AS (SELECT term, ln((1 + (SELECT count(*) FROM VCLEAN)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM b GROUP BY term HAVING count(*) >= 2),
    n AS (SELECT id, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS w FROM b JOIN i USING (term))
    SELECT id, count(*) AS terms, round(max(w), 6) AS most, round(sum(w), 5) AS total FROM n GROUP BY id""".replace("VCLEAN", f"(SELECT doc_id AS id, {S.clean_sql(chr(39) * 2, 'text')} AS text FROM documents)"),
)
def tx_03(spark, d):
    rows = S.spread(S.table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), X.clean(F.lit(""), F.col("text")).alias("text"))
    view = V.tfidf_view(rows, X.word_ngrams(F.col("text"), 1, 2), binary=True)
    return view.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("most"), F.round(F.sum("w"), 5).alias("total"))


@query(
    "tx_04_bm25",
    r"""SELECT q_id, rank, n_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, n_id) AS rank FROM (
    SELECT q.q_id, d.n_id, round(sum(d.w) / greatest(any_value(b.bound), 1e-6), 6) AS sim FROM
    (SELECT DISTINCT e.id AS q_id, term FROM (SELECT id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM v_eval) e JOIN v_bidf USING (term)) q
    JOIN (SELECT id AS n_id, term, tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / (SELECT sum(tf) / (SELECT count(*) FROM v_clean)::DOUBLE FROM v_terms JOIN v_bidf USING (term)))) * idf AS w
      FROM (SELECT t.id, t.term, t.tf, i.idf, sum(t.tf) OVER (PARTITION BY t.id) AS size FROM v_terms t JOIN v_bidf i USING (term))) d USING (term)
    JOIN (SELECT q_id, sum(idf) * 2.2 AS bound FROM (SELECT DISTINCT id AS q_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM v_eval) JOIN v_bidf USING (term) GROUP BY q_id) b ON b.q_id = q.q_id
    GROUP BY q.q_id, d.n_id)) WHERE rank <= 10""",
)
def tx_04(spark, d):
    from textengine.operators.similarity import sparse_topk

    return sparse_topk(*V.bm25_sides(S.evals(spark, d), docs(spark, d)), 10).select("q_id", "rank", "n_id", "sim")


VIEWS["v_bidf"] = "SELECT term, ln(1 + ((SELECT count(*) FROM v_clean) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM v_terms GROUP BY term HAVING count(*) >= 2"


@query("tx_05_onehot_tokens", "SELECT DISTINCT id, unnest(['queue=' || queue, 'lang=' || language]) AS token FROM v_tickets")
def tx_05(spark, d):
    t = S.tickets(spark, d).withColumn("doc", F.concat(F.lit("queue="), "queue", F.lit(" lang="), "language"))
    return V.onehot(t, "doc")


@query(
    "tx_06_oov_rate",
    r"""SELECT e.id, round(coalesce(o.oov, 0.0), 6) AS oov FROM v_xx e LEFT JOIN (SELECT id, avg(CASE WHEN v.term IS NULL THEN 1.0 ELSE 0.0 END) AS oov FROM
    (SELECT id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS term FROM v_xx) w
    LEFT JOIN (SELECT term FROM (SELECT DISTINCT id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM v_en) GROUP BY term HAVING count(*) >= 2) v ON v.term = w.term GROUP BY id) o ON o.id = e.id""",
)
def tx_06(spark, d):
    vocab = V.fit_vocab(V.token_rows(S.pool_en(spark, d)), 2)
    return V.oov_rate(S.pool_xx(spark, d), vocab).select("id", F.round("oov", 6).alias("oov"))


@query(
    "tx_07_conjunctions",
    """WITH top AS (SELECT id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, term) AS place FROM v_tfidf) WHERE place <= 8),
    p AS (SELECT a.id, a.term || '&' || b.term AS term, a.w * b.w AS w FROM top a JOIN top b ON a.id = b.id AND a.term < b.term)
    SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM p) WHERE df >= 2""",
)
def tx_07(spark, d):
    return V.conjunctions(V.tfidf_view(docs(spark, d)), 2, 2, 8).select("id", "term", F.round("w", 6).alias("w"))


VIEWS["v_top8"] = "SELECT id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, term) AS place FROM v_tfidf) WHERE place <= 8"
VIEWS["v_pairs"] = """SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (
 SELECT a.id, a.term || '&' || b.term AS term, a.w * b.w AS w FROM v_top8 a JOIN v_top8 b ON a.id = b.id AND a.term < b.term)) WHERE df >= 2"""


@query(
    "tx_08_hash_pairs",
    "SELECT id, CAST(CAST('0x' || left(md5(term), 8) AS BIGINT) % 4096 AS INTEGER) AS bucket, round(sum(CASE WHEN substring(md5(term), 9, 1) < '8' THEN w ELSE -w END), 6) AS w FROM v_pairs GROUP BY id, bucket",
)
def tx_08(spark, d):
    return V.hash_features(V.conjunctions(V.tfidf_view(docs(spark, d)), 2, 2, 8), 4096).select("id", "bucket", F.round("w", 6).alias("w"))


@query("tx_09_lsa")
def tx_09(spark, d):
    from textengine.operators import lsa as L

    return L.lsa(V.tfidf_view(docs(spark, d), min_df=10))


_KEY = f"list_distinct(list_filter(regexp_extract_all(text, '[a-z][a-z'']+'), lambda w: length(w) > 2 AND NOT list_contains({lst(X.STOP_WORDS)}, w)))"


@query(
    "tx_10_contrast_keywords",
    f"""SELECT term, c1, round(((c1 + 1) / ((SELECT count(*) FROM v_clean WHERE queue = 'src0') + 2)::DOUBLE) / ((c0 + 1) / ((SELECT count(*) FROM v_clean WHERE queue <> 'src0') + 2)::DOUBLE), 6) AS ratio
    FROM (SELECT term, count(*) FILTER (queue = 'src0') AS c1, count(*) FILTER (queue <> 'src0') AS c0 FROM (SELECT queue, unnest({_KEY}) AS term FROM v_clean) GROUP BY term) WHERE c1 >= 3 ORDER BY ratio DESC, term LIMIT 12""",
)
def tx_10(spark, d):
    return V.contrast_keywords(docs(spark, d).withColumn("flag", F.col("queue") == "src0"), "flag")


@query("tx_11_family_weights", "SELECT id, n AS size, round(1.0::DOUBLE / n, 6) AS w_inverse, round(1 / sqrt(n), 6) AS w_sqrt, CASE WHEN n = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w_single FROM (SELECT id, count(*) OVER (PARTITION BY md5(text)) AS n FROM v_clean)")
def tx_11(spark, d):
    rows = V.family_weights(docs(spark, d).withColumn("family", F.md5("text")))
    return rows.select("id", "size", F.round("w_inverse", 6).alias("w_inverse"), F.round("w_sqrt", 6).alias("w_sqrt"), "w_single")


@query("tx_12_class_weights", "SELECT queue, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight FROM (SELECT queue, count(*) AS n FROM v_tickets GROUP BY queue)")
def tx_12(spark, d):
    return V.class_weights(S.tickets(spark, d), "queue").withColumn("weight", F.round("weight", 6))


@query(
    "tx_13_encode_sequences",
    r"""WITH w AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS position FROM (SELECT id, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS t FROM v_clean)),
    v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) + 1 AS token_id FROM w GROUP BY term ORDER BY count(*) DESC, term LIMIT 2000)
    SELECT c.id, CAST(p.position AS INTEGER) AS position, CAST(CASE WHEN w.term IS NULL THEN 0 ELSE coalesce(v.token_id, 1) END AS INTEGER) AS token_id FROM v_clean c CROSS JOIN (SELECT unnest(range(0, 30)) AS position) p
    LEFT JOIN w ON w.id = c.id AND w.position = p.position LEFT JOIN v ON v.term = w.term""".replace("WITH w AS", "WITH w AS"),
)
def tx_13(spark, d):
    return V.encode_sequences(docs(spark, d), 2000, 30)
