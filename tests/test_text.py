"""Scalar text functions on fixed cases."""

import pytest
from pyspark.sql import functions as F

from textengine.functions import text as X
from textengine.operators import quality as Q


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "subject,body,want",
    [
        ("Refund REQUEST", "See https://example.com or mail me@bank.com about TICKET-12345.", "refund request . see or mail about ticket-12345."),
        (None, "body only", ". body only"),
        ("", "", "."),
        (None, None, "."),
    ],
)
def test_clean(spark, subject, body, want):
    assert one(spark, X.clean(F.col("s"), F.col("b")), s=subject, b=body) == want


def test_clean_keeps_ids_and_cuts(spark):
    assert "ticket-12345" in one(spark, X.clean(F.col("s"), F.col("b")), s="", b="about TICKET-12345")
    assert len(one(spark, X.clean(F.col("s"), F.col("b"), X.MAX_CHARS), s="", b="ab " * 2000)) == 2000


def test_sentences_and_language(spark):
    assert one(spark, X.sentences(F.col("t")), t="One. Two!  Three\n\nfour: five\\nsix") == ["One.", "Two!", "Three", "four:", "five", "six"]
    assert one(spark, X.is_english(F.col("t")), t="please help with the order")
    assert not one(spark, X.is_english(F.col("t")), t="bitte helfen sie mit der bestellung")


def test_ngrams(spark):
    assert one(spark, X.word_ngrams(F.col("t"), 1, 2), t="ab cd ef") == ["ab", "cd", "ef", "ab cd", "cd ef"]
    assert one(spark, X.word_ngrams(F.col("t"), 1, 2), t="x") == []
    assert one(spark, X.char_ngrams(F.col("t"), 3, 3), t="ab c") == [" ab", "ab ", " c "]


def test_redact_and_slug(spark):
    assert one(spark, X.redact(F.col("t")), t="call 0151 234-5678 now") == "call [number] now"
    assert one(spark, X.slug(F.col("t")), t="--A b/c!") == "A_b_c"


def test_chunks_keep_all_words(spark):
    text = ", ".join(f"part {i} of it" for i in range(30))
    df = Q.chunk_sentences(spark.createDataFrame([(text,), ("short",)], "s string"), "s", 20)
    pieces = [r["pieces"] for r in df.collect()]
    assert " ".join(pieces[0]) == text and all(len(p.split()) <= 20 for p in pieces[0]) and pieces[1] == ["short"]


def test_validate(spark):
    rows = spark.createDataFrame([("", "  ", "en"), ("x" * 301, "b", "de"), ("s", "b", "fr"), ("s", "b", "auto")], "subject string, body string, language string")
    assert [r["reasons"] for r in Q.validate(rows).collect()] == [["empty"], ["subject_too_long"], ["language"], []]
