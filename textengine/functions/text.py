"""Scalar text functions: from Column to Column, all inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns below must match what the surveyed operators match.
#: White space of Unicode, as both Java and RE2 spell it.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What collapses to one blank: all runs but a single blank.
RUN = WS.replace(r"\x20", r"\x1f") + WS + "*| " + WS + "+"
#: A word as vectorizers see it: two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
LETTERS_DE = r"[a-zäöüß]+"
KEYWORD = r"[a-z][a-z']+"
RARE = r"[a-z][a-z0-9\-]{2,}"
DIGIT_RUN = r"[0-9][0-9\s\-]{6,}[0-9]"
#: What cleaning turns into blanks. An address begins where its run of characters does: only there is it
#: looked for, as a search from every character would take time by the square of the run's length.
URL = r"https?://\S+"
MAIL = r"(?<!\S)\S+@\S+"
TICKET = r"\b[A-Z]{2,}-?[0-9]{3,}\b"
#: Fixed value: characters that a cleaned ticket keeps (PF-01).
MAX_CHARS = 2000

#: Stop words that decide whether a sentence is English.
EN_WORDS = "the and to of is for with that this have please would could our your are we you i on it be can any my has not or by from".split()
DE_WORDS = "der die das und ist nicht ich wir sie zu mit für auf ein eine den dem von bitte können wurde dass haben es im des sich auch bei um zur zum einen einer wird sind".split()
#: Stop words that decide whether a document looks English.
EN_DOC_WORDS = "the and to of is are for with this that our we you please have has been can could would your on in an it as be i my".split()
DE_DOC_WORDS = "der die das und ist sind für mit wir sie bitte haben hat wurde können könnten ihre ihr auf in ein eine es als ich mein nicht zu den dem des".split()
#: Words that are no keywords.
STOP_WORDS = (
    "a an the and or but if to of in on for with at by from as is are was were be been being it its this that these those i we you they he she "
    "my our your their me us them please thank thanks hello dear regards best support customer team would could can will just also any some more "
    "very have has had do does did not no so than then there here what which who when where how all about into out up down over after before "
    "while because such only own same too s t don now"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def clean(subject: Column, body: Column, most: int | None = None) -> Column:
    """Subject and body in lower case, without addresses, white space collapsed. Nulls are empty;
    both empty leave the joiner's dot. most: characters to keep, where short tickets are wanted. The id pattern follows the lower-casing and so never
    matches, which keeps ticket ids; it is not looked for. Nor are addresses where their sign is missing, or single blanks."""
    text = F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit(" . "), F.coalesce(body, F.lit(""))))
    for pattern, sign in ((URL, "://"), (MAIL, "@")):
        text = let(text, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, " ")).otherwise(t))  # noqa: B023
    text = F.trim(F.regexp_replace(text, RUN, " "))
    return text if most is None else F.substring(text, 1, most)


def redact(text: Column) -> Column:
    """Long runs of digits become [number]."""
    return F.regexp_replace(text, DIGIT_RUN, "[number]")


def subject_of(text: Column) -> Column:
    """What stands before the first ' . '; empty without one."""
    return F.when(F.instr(text, " . ") > 0, F.substring_index(text, " . ", 1)).otherwise(F.lit(""))


def body_of(text: Column) -> Column:
    """What stands after the first ' . '; the whole text without one."""
    at = F.instr(text, " . ")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(text)


def sentences(text: Column) -> Column:
    """array<string>: cut after end punctuation with white space and at line breaks."""
    plain = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit(" ")), F.lit("\\r"), F.lit(" "))
    cut = F.split(F.regexp_replace(plain, r"([.!?:;])\s+", "$1\n"), "\n+")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|(?<!\s)\s+$", "")), lambda s: s != "")


def hits(tokens: Column, names: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: F.array_contains(words(names), t)))


def is_english(sentence: Column) -> Column:
    found = F.regexp_extract_all(F.lower(sentence), F.lit(LETTERS_DE), F.lit(0))
    e, d = hits(found, EN_WORDS), hits(found, DE_WORDS)
    return ((e >= 1) & (d == 0)) | ((e >= 3) & (e >= 3 * d))


def looks_english(text: Column) -> Column:
    found = F.split(F.trim(F.regexp_replace(text, WS + "+", " ")), " ")
    return hits(found, EN_DOC_WORDS) > 2 * hits(found, DE_DOC_WORDS)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def keyword_tokens(text: Column) -> Column:
    return F.filter(tokens(text, KEYWORD), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def word_ngrams(text: Column, low: int = 1, high: int = 2) -> Column:
    none = F.array().cast("array<string>")

    def grams(found: Column) -> Column:
        def of(n: int) -> Column:
            last = F.size(found) - (n - 1)
            return found if n == 1 else F.when(last >= 1, F.zip_with(F.slice(of(n - 1), F.lit(1), last), F.slice(found, F.lit(n), last), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(none)

        return F.concat(*[of(n) for n in range(low, high + 1)])

    return let(tokens(text), grams)


def char_ngrams(text: Column, low: int = 3, high: int = 5, in_words: bool = True) -> Column:
    """Character n-grams, of each word between blanks (in_words) or of the whole text. A
    word shorter than n counts once as a whole."""
    units = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" "))) if in_words else F.array(text)

    def of(unit: Column, n: int) -> Column:
        last = F.length(unit) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(unit, i, F.lit(n))))

    none = F.array().cast("array<string>")
    return F.flatten(F.transform(units, lambda u: F.concat(*[F.coalesce(of(u, n), none) for n in range(low, high + 1)])))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def hash_half(text: Column, n: int = 2) -> Column:
    """Bucket of a text from the last hexadecimal digit of its md5; n divides 16."""
    return (F.conv(F.right(F.md5(text.cast("binary")), F.lit(1)), 16, 10).cast("int") % n).cast("int")


def l2norm(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def count_of(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def style_features(text: Column) -> dict[str, Column]:
    """22 counts of the surface of a cleaned text, without its topic."""
    subject = subject_of(text)
    found = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    head, tail = (lambda n: F.left(text, F.lit(n))), F.right(text, F.lit(200))
    flag = lambda c: c.cast("int")
    total = F.aggregate(found, F.lit(0).cast("long"), lambda s, w: s + F.length(w))
    return {
        "n_chars": F.length(text).cast("long"),
        "n_words": F.size(found).cast("long"),
        "subject_chars": F.length(subject).cast("long"),
        "no_subject": flag(subject == ""),
        "n_br": count_of(text, "<br"),
        "n_escapes": count_of(text, "\\n"),
        "n_commas": count_of(text, ","),
        "n_dots": count_of(text, "."),
        "n_questions": count_of(text, "?"),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
        "starts_dear": flag(F.startswith(text, F.lit("dear"))),
        "dear_support": flag(F.contains(text, F.lit("dear customer support"))),
        "has_hello": flag(F.contains(head(80), F.lit("hello"))),
        "has_hi": flag(F.contains(head(40), F.lit("hi "))),
        "has_thank": flag(F.contains(tail, F.lit("thank"))),
        "has_regards": flag(F.contains(tail, F.lit("regards"))),
        "mean_word": F.round(F.when(F.size(found) > 0, total / F.size(found)).otherwise(F.lit(0.0)), 6),
        "cut_off": flag(F.length(text) >= MAX_CHARS - 1),
        "n_exclaims": count_of(text, "!"),
        "n_colons": count_of(text, ":"),
        "n_dashes": count_of(text, "-"),
        "n_parens": count_of(text, "("),
    }
