"""Word and line statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD, added, map_texts, sliced, words_of

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 5
NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows of `window` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(window):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[j : j + n] + np.uint64((j + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += twice
    cover[window : window + n] -= twice
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(NAMES)
    words = words_of(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def with_stats(df: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns `keep` and the statistics NAMES of each row's whole text (null: all 0)."""
    keep = tuple(c for c in keep if c not in NAMES)
    out = [T.StructField(n, T.LongType()) for n in NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            found = [text_stats(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found)) or [()] * len(NAMES)
            yield added(batch, out, [pa.array(c, pa.int64()) for c in columns])

    return map_texts(df, keep, text, run, out)
