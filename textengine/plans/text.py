"""Queries of the scalar text functions and filters (PF, FL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textengine.functions import text as X
from textengine.operators import quality as Q
from textengine.operators import vectorize as V

from . import views as S
from .registry import query


def lst(names: list[str]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def hits(tokens: str, names: list[str]) -> str:
    return f"len(list_filter({tokens}, lambda x: list_contains({lst(names)}, x)))"


SENTENCES = (
    r"list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(replace(replace(coalesce({0}, ''), '\n', chr(10)), '\t', ' '), '\r', ' '), '([.!?:;])\s+', '\1' || chr(10), 'g'), '\n+'),"
    r" lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
)
WORDS = "regexp_extract_all(lower({0}), '" + X.LETTERS_DE + "')"
IS_EN = f"(({hits(WORDS, X.EN_WORDS)} >= 1 AND {hits(WORDS, X.DE_WORDS)} = 0) OR ({hits(WORDS, X.EN_WORDS)} >= 3 AND {hits(WORDS, X.EN_WORDS)} >= 3 * {hits(WORDS, X.DE_WORDS)}))"


@query("pf_01_clean", f"SELECT id, left(text, {X.MAX_CHARS}) AS text FROM v_clean")
def pf_01(spark, d):
    return S.cleaned(spark, d, X.MAX_CHARS).select("id", "text")


@query("pf_02_redact", r"SELECT doc_id AS id, regexp_replace(text, '[0-9][0-9\s\-]{6,}[0-9]', '[number]', 'g') AS text FROM documents")
def pf_02(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.redact(F.col("text")).alias("text"))


@query(
    "pf_03_split_subject",
    "SELECT id, CASE WHEN instr(text, ' . ') > 0 THEN split_part(text, ' . ', 1) ELSE '' END AS subject,"
    " CASE WHEN instr(text, ' . ') > 0 THEN substring(text, instr(text, ' . ') + 3) ELSE text END AS body FROM v_clean",
)
def pf_03(spark, d):
    return S.cleaned(spark, d).select("id", X.subject_of(F.col("text")).alias("subject"), X.body_of(F.col("text")).alias("body"))


@query("pf_04_sentences", f"SELECT doc_id AS id, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '|') AS sentences FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents)")
def pf_04(spark, d):
    s = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.sentences(F.col("text")).alias("s"))
    return s.select("id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("sentences"))


@query("pf_05_is_english", f"SELECT id, i, {IS_EN.format('s')} AS english FROM (SELECT id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id AS id, {SENTENCES.format('text')} AS s FROM documents))")
def pf_05(spark, d):
    s = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(X.sentences(F.col("text"))).alias("i", "s"))
    return s.select("id", F.col("i").cast("long").alias("i"), X.is_english(F.col("s")).alias("english"))


_DOC_WORDS = f"string_split(trim(regexp_replace(text, '{X.WS}+', ' ', 'g')), ' ')"


@query("pf_06_looks_english", f"SELECT doc_id AS id, {hits(_DOC_WORDS, X.EN_DOC_WORDS)} > 2 * {hits(_DOC_WORDS, X.DE_DOC_WORDS)} AS english FROM documents")
def pf_06(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.looks_english(F.col("text")).alias("english"))


_FLAGS = f"SELECT doc_id AS id, {SENTENCES.format('text')} AS s FROM documents"
_EN_COUNT = f"len(list_filter(s, lambda z: {IS_EN.format('z')}))"


@query("pf_07_route_language", f"SELECT id, CASE WHEN 2 * (len(s) - {_EN_COUNT}) > len(s) THEN 'de' ELSE 'en' END AS language FROM ({_FLAGS})")
def pf_07(spark, d):
    return Q.route_language(S.table(spark, d, "documents").withColumnRenamed("doc_id", "id")).select("id", "language")


@query("pf_08_english_share", f"SELECT id, CASE WHEN len(s) > 0 THEN round({_EN_COUNT} / len(s)::DOUBLE, 3) ELSE 0.0 END AS share FROM ({_FLAGS})")
def pf_08(spark, d):
    return Q.route_language(S.table(spark, d, "documents").withColumnRenamed("doc_id", "id")).select("id", "share")


_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
#: The pieces so far in one string, char 1 between them; the last one is still open.
_OPEN = "string_split(acc, chr(1))[-1]"
_LONGER = f"trim({_OPEN} || ' ' || part)"
_PACK = f"CASE WHEN {_OPEN} <> '' AND {_WORDS.format(_LONGER)} > 20 THEN acc || chr(1) || part ELSE left(acc, length(acc) - length({_OPEN})) || {_LONGER} END"


@query(
    "pf_09_chunk_sentences",
    rf"""SELECT id, CAST(i AS INTEGER) AS i, sentence, CASE WHEN {_WORDS.format("sentence")} > 20 THEN
    replace(list_reduce(list_concat([''], string_split(regexp_replace(sentence, ',\s+', ',' || chr(1), 'g'), chr(1))), lambda acc, part: {_PACK}), chr(1), chr(10)) ELSE sentence END AS pieces
    FROM (SELECT doc_id AS id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents))""",
)
def pf_09(spark, d):
    s = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(X.sentences(F.col("text"))).alias("i", "sentence"))
    return Q.chunk_sentences(s, "sentence", 20).select("id", "i", "sentence", F.array_join("pieces", "\n").alias("pieces"))


@query(
    "pf_10_keyword_tokens",
    f"SELECT id, CAST(len(k) AS BIGINT) AS n, array_to_string(k, ' ') AS keywords FROM (SELECT id, list_filter(regexp_extract_all(text, '[a-z][a-z'']+'), lambda w: length(w) > 2 AND NOT list_contains({lst(X.STOP_WORDS)}, w)) AS k FROM v_clean)",
)
def pf_10(spark, d):
    k = S.cleaned(spark, d).select("id", X.keyword_tokens(F.col("text")).alias("k"))
    return k.select("id", F.size("k").cast("long").alias("n"), F.array_join("k", " ").alias("keywords"))


@query(
    "pf_11_word_ngrams",
    r"""SELECT gram, count(*) AS n FROM (SELECT unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram
    FROM (SELECT regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS t FROM v_clean)) GROUP BY gram""",
)
def pf_11(spark, d):
    return S.cleaned(spark, d).select(F.explode(X.word_ngrams(F.col("text"), 1, 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(
    "pf_12_char_ngrams",
    r"""SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(u) - n + 2), lambda i: substring(u, i, n))) AS gram FROM
    (SELECT ' ' || w || ' ' AS u FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM v_clean) WHERE w <> ''), (SELECT unnest([3, 4]) AS n) WHERE length(u) >= n) GROUP BY gram""",
)
def pf_12(spark, d):
    # A word is cut once, however often it occurs.
    words = S.cleaned(spark, d).select(F.explode(F.split("text", r"\s+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.select("n", F.explode(X.char_ngrams(F.col("w"), 3, 4)).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))


@query(
    "pf_13_rare_tokens",
    r"""SELECT id, CAST(count(*) AS BIGINT) AS n, string_agg(term, ' ' ORDER BY term) AS rare FROM (SELECT id, term, count(*) OVER (PARTITION BY term) AS df FROM
    (SELECT DISTINCT id, unnest(regexp_extract_all(text, '[a-z][a-z0-9\-]{2,}')) AS term FROM v_clean)) WHERE df BETWEEN 2 AND 30 GROUP BY id""",
)
def pf_13(spark, d):
    r = V.rare_tokens(S.cleaned(spark, d), 2, 30)
    return r.select("id", F.size("rare").cast("long").alias("n"), F.array_join("rare", " ").alias("rare"))


def _style_sql() -> str:
    n = lambda p: f"CAST((length(text) - length(replace(text, '{p}', ''))) / {len(p)} AS BIGINT)"
    subject = "CASE WHEN instr(text, ' . ') > 0 THEN split_part(text, ' . ', 1) ELSE '' END"
    w = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
    cols = {
        "n_chars": "length(text)", "n_words": f"CAST(len({w}) AS BIGINT)", "subject_chars": f"length({subject})", "no_subject": f"CAST({subject} = '' AS INT)",
        "n_br": n("<br"), "n_escapes": n("\\n"), "n_commas": n(","), "n_dots": n("."), "n_questions": n("?"), "n_digits": "CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT)",
        "starts_dear": "CAST(starts_with(text, 'dear') AS INT)", "dear_support": "CAST(contains(text, 'dear customer support') AS INT)", "has_hello": "CAST(contains(left(text, 80), 'hello') AS INT)",
        "has_hi": "CAST(contains(left(text, 40), 'hi ') AS INT)", "has_thank": "CAST(contains(right(text, 200), 'thank') AS INT)", "has_regards": "CAST(contains(right(text, 200), 'regards') AS INT)",
        "mean_word": f"round(CASE WHEN len({w}) > 0 THEN list_sum(list_transform({w}, lambda x: length(x)))::DOUBLE / len({w}) ELSE 0.0 END, 6)", "cut_off": "CAST(length(text) >= 1999 AS INT)",
        "n_exclaims": n("!"), "n_colons": n(":"), "n_dashes": n("-"), "n_parens": n("("),
    }
    return "SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM v_clean"


@query("pf_14_style_features", _style_sql())
def pf_14(spark, d):
    return S.cleaned(spark, d).select("id", *[c.alias(k) for k, c in X.style_features(F.col("text")).items()])


_TAGS = "list_filter([queue, language, CASE WHEN type = 1 THEN 'good, checked text' END, CASE WHEN priority = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)"


@query(
    "pf_15_meta_doc",
    f"""SELECT id, array_to_string(list_concat(['type=' || coalesce(CAST(type AS VARCHAR), 'none'), 'prio=' || coalesce(CAST(priority AS VARCHAR), 'none')],
    list_transform(list_filter(flatten(list_transform({_TAGS}, lambda t: string_split(t, ','))), lambda x: trim(x) <> ''), lambda x: 'tag=' || replace(lower(trim(x)), ' ', '_'))), ' ') AS doc FROM v_tickets""",
)
def pf_15(spark, d):
    return Q.meta_doc(Q.collect_tags(_tagged(spark, d), ["tag_1", "tag_2", "tag_3", "tag_4"])).select("id", "doc")


def _tagged(spark, d):
    t = S.tickets(spark, d)
    return t.withColumns({"tag_1": F.col("queue"), "tag_2": F.col("language"), "tag_3": F.when(F.col("type") == 1, "good, checked text"), "tag_4": F.when(F.col("priority") == 1, "toxic")})


@query("pf_16_collect_tags", f"SELECT id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, '|') AS tags FROM (SELECT id, {_TAGS} AS t FROM v_tickets)")
def pf_16(spark, d):
    t = Q.collect_tags(_tagged(spark, d), ["tag_1", "tag_2", "tag_3", "tag_4"])
    return t.select("id", F.size("tags").cast("long").alias("n"), F.array_join("tags", "|").alias("tags"))


@query(
    "pf_17_prefix_contained",
    "SELECT d.id AS id, e.id AS eval_id FROM (SELECT id, left(text, 40) AS head, split_part(text, ' ', 2) AS w FROM v_eval) e JOIN v_clean d ON contains(d.text, e.head)",
)
def pf_17(spark, d):
    return Q.prefix_contained(S.evals(spark, d), S.cleaned(spark, d), 40).select(F.col("b_id").alias("id"), F.col("a_id").alias("eval_id"))


@query("pf_18_slug", "SELECT page_id AS id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def pf_18(spark, d):
    return S.table(spark, d, "pages").select(F.col("page_id").alias("id"), X.slug(F.col("url")).alias("slug"))


@query("pf_19_hash_half", "SELECT id, CAST(CAST(concat('0x', right(md5(text), 1)) AS INTEGER) % 2 AS INTEGER) AS half FROM v_clean")
def pf_19(spark, d):
    return S.cleaned(spark, d).select("id", X.hash_half(F.col("text")).alias("half"))


@query("pf_20_encode_labels", "SELECT id, queue, CAST(dense_rank() OVER (ORDER BY queue) - 1 AS INTEGER) AS label FROM v_tickets")
def pf_20(spark, d):
    return Q.encode_labels(S.tickets(spark, d), "queue").select("id", "queue", "label")


@query("pf_21_l2norm", "SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2, round(v[1], 6) AS first FROM (SELECT id, list_transform(vec, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(vec, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM v_dense)")
def pf_21(spark, d):
    v = S.dense(spark, d).select("id", X.l2norm(F.col("vec")).alias("v"))
    return v.select("id", F.round(X.dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("fl_01_filter_pool", "SELECT id, language, queue FROM v_clean WHERE language = 'en' AND queue IN ('src0', 'src1', 'src2') AND text <> ''")
def fl_01(spark, d):
    return Q.filter_pool(S.cleaned(spark, d), "en", ["src0", "src1", "src2"]).select("id", "language", "queue")


@query("fl_02_length_between", "SELECT band, count(*) AS n FROM (SELECT unnest(['40-1500', '40-3000', 'short']) AS band, length(text) AS n FROM documents) WHERE (band = '40-1500' AND n BETWEEN 40 AND 1500) OR (band = '40-3000' AND n BETWEEN 40 AND 3000) OR (band = 'short' AND n <= 1100) GROUP BY band")
def fl_02(spark, d):
    docs = S.table(spark, d, "documents")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), Q.length_between(F.col("text"), lo, hi).alias("ok")) for b, lo, hi in (("40-1500", 40, 1500), ("40-3000", 40, 3000), ("short", 0, 1100))])
    return docs.select(F.inline(bands)).where("ok").groupBy("band").agg(F.count("*").alias("n"))


@query("fl_03_recent", "SELECT id, created_at FROM v_pred WHERE created_at >= (SELECT max(created_at) FROM v_pred) - INTERVAL 7 DAY")
def fl_03(spark, d):
    return Q.recent(S.predictions(spark, d), 7).select("id", "created_at")


@query("fl_04_served_version", "SELECT id, version FROM v_pred WHERE version = 'v2' AND api_key NOT IN (1, 2, 3)")
def fl_04(spark, d):
    return Q.exclude_keys(Q.served_version(S.predictions(spark, d), "v2"), [1, 2, 3]).select("id", "version")


@query(
    "fl_05_validate",
    """SELECT id, reasons = '' AS ok, reasons FROM (SELECT id, array_to_string(list_filter([CASE WHEN trim(coalesce(subject, '')) = '' AND trim(coalesce(body, '')) = '' THEN 'empty' END,
    CASE WHEN length(subject) > 300 THEN 'subject_too_long' END, CASE WHEN length(body) > 8000 THEN 'body_too_long' END,
    CASE WHEN language NOT IN ('auto', 'en', 'de') THEN 'language' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v_tickets)""",
)
def fl_05(spark, d):
    return Q.validate(S.tickets(spark, d)).select("id", "ok", F.array_join("reasons", ",").alias("reasons"))


@query("fl_06_judge_filter", "SELECT id, queue FROM v_clean WHERE queue = 'src' || CAST(id % 20 AS VARCHAR)")
def fl_06(spark, d):
    docs = S.cleaned(spark, d)
    judged = docs.select("id", F.concat(F.lit("src"), (F.col("id") % 20).cast("string")).alias("pred"))
    return Q.judge_filter(docs, judged, "queue").select("id", "queue")
