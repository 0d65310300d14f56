"""Scalar operators as temporary SQL functions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as X

#: name -> (parameters, body). Bodies are SQL, so queries keep their whole-stage code.
FUNCTIONS = {
    "te_redact": ("t STRING", rf"regexp_replace(t, r'{X.DIGIT_RUN}', '[number]')"),
    "te_subject": ("t STRING", "CASE WHEN instr(t, ' . ') > 0 THEN substring_index(t, ' . ', 1) ELSE '' END"),
    "te_body": ("t STRING", "CASE WHEN instr(t, ' . ') > 0 THEN substring(t, instr(t, ' . ') + 3) ELSE t END"),
    "te_slug": ("t STRING", "regexp_replace(regexp_replace(t, '[^A-Za-z0-9]+', '_'), '^_+|_+$', '')"),
    "te_tokens": ("t STRING", rf"regexp_extract_all(t, r'{X.TOKEN}', 0)"),
    "te_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
}

#: name -> (parameters, columns, body): table functions, for LATERAL joins.
TABLES = {
    "te_sentences": (
        "t STRING",
        "pos INT, sentence STRING",
        r"""SELECT pos, col FROM posexplode(filter(transform(split(regexp_replace(replace(replace(replace(coalesce(t, ''), r'\n', '\n'), r'\t', ' '), r'\r', ' '), r'([.!?:;])\s+', '$1\n'), r'\n+'),
         s -> regexp_replace(s, r'^\s+|\s+$', '')), s -> s <> ''))""",
    ),
    "te_ngrams": (
        "t STRING, n INT",
        "pos INT, gram STRING",
        rf"""SELECT at, array_join(slice(w, at + 1, n), ' ') FROM (SELECT regexp_extract_all(t, r'{X.TOKEN}', 0) AS w) LATERAL VIEW explode(IF(size(w) < n, CAST(array() AS ARRAY<INT>), sequence(0, size(w) - n))) AS at""",
    ),
}


def register_all(spark: SparkSession) -> None:
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
