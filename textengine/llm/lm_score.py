"""Operator 1: language-model scoring by cross-entropy difference.

Two matched bigram models, of the target rows and of all rows (the background), share one
vocabulary, one smoothing and one set of bigrams; a document's score is its mean loss per token
under the target model minus that under the background model, so low scores are like the target.
Tokens are the lower-case words and one end mark per text.

p(w|h) = weight * c(h,w) / c(h) + (1 - weight) * p(w), p(w) = (c(w) + 1) / (N + V), where V is the
number of different tokens and one unknown, and p(w|h) = p(w) for an h without rows in the model.
Every word and bigram counts, also those seen once; what is gathered grows with the rows.

Texts are read once, in chunks of bounded size, and kept as token numbers; texts are never shuffled. A chunk asks for the counts of its own distinct
words and bigrams: their sorted hashes, cut into ranges, are one packed row per chunk and range.
Ranges are grouped, counts summed over the chunks, and each chunk gets its answers back in the
order in which it asked. So a word or bigram is one entry per chunk, however often it occurs: no key
is hot, nothing is broadcast, and the driver gets three totals. Counts stand under hashes of
48 bits, so in very large corpora a few words or bigrams in a thousand share their counts with another.

A null text counts as empty: its only token is the end mark. Repeated rows count as often as they
occur; without target rows the target model is uniform over what is seen. An empty table gives an empty result.
Columns of `keep` named like the operator's own are replaced.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, drop_shuffles, materialize, sliced, words_of

NAMES = ("n_words", "target_loss", "background_loss", "score")
#: Kinds of rows that are no requests: documents, and a chunk's tokens.
_DOCUMENT, _TOKENS = -2, -1
#: Bits of a key.
_BITS = 48


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers by planes of their bytes, deflated."""
    return zlib.compress(values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, in 32 bits if they have room there. Of those only the highest bytes are
    deflated, as the others are random."""
    steps = np.diff(keys, prepend=np.uint64(0))
    if len(steps) > 1 and int(steps[1:].max()) < 1 << 32:
        planes = steps[1:].astype("<u4").view(np.uint8).reshape(-1, 4)
        high = zlib.compress(planes[:, 3].tobytes(), 1)
        return b"\4" + int(steps[0]).to_bytes(8, "little") + len(high).to_bytes(4, "little") + high + planes[:, :3].tobytes()
    return b"\10" + steps.astype("<u8").tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.cumsum(np.frombuffer(raw, "<u8", offset=1), dtype=np.uint64)
    low = 13 + int.from_bytes(raw[9:13], "little")
    rest = np.empty(((len(raw) - low) // 3, 4), np.uint8)
    rest[:, :3] = np.frombuffer(raw, np.uint8, offset=low).reshape(-1, 3)
    rest[:, 3] = np.frombuffer(zlib.decompress(raw[13:low]), np.uint8)
    return np.cumsum(np.concatenate((np.array([int.from_bytes(raw[1:9], "little")], np.uint64), rest.view("<u4").reshape(-1).astype(np.uint64))), dtype=np.uint64)


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens within these texts, the number of tokens of each text, and the hash
    of each number (its _BITS highest bits); 0 is the end mark, which has the hash of the empty word, and
    the others go by falling count, so that frequent words have small numbers, which pack well."""
    ids: defaultdict[str, int] = defaultdict()
    ids.default_factory = ids.__len__
    ids[""]  # number 0
    flat, sizes = array("I"), []
    for t in texts:
        words = words_of(t.lower()) if t else []
        flat.extend(map(ids.__getitem__, words))
        flat.append(0)
        sizes.append(len(words) + 1)
    code = pd.util.hash_array(np.array(list(ids), object), categorize=False) & ~np.uint64((1 << (64 - _BITS)) - 1)
    flat = np.frombuffer(flat, np.uint32)
    order = np.concatenate(([0], np.argsort(-np.bincount(flat, minlength=len(code))[1:], kind="stable") + 1))
    number = np.empty(len(code), np.int64)
    number[order] = np.arange(len(code))
    return number[flat], np.array(sizes, np.int64), code[order]


class _Keys:
    """Distinct words and bigrams of a chunk, and their keys in ascending order."""

    def __init__(self, flat: np.ndarray, code: np.ndarray):
        before = np.concatenate((np.zeros(1, np.int64), flat[:-1]))
        pair, self.pair_of_token = np.unique(before * len(code) + flat, return_inverse=True)
        self.first, self.second = pair // len(code), pair % len(code)
        h = code[self.first]
        mixed = (h << np.uint64(1) | h >> np.uint64(63)) ^ code[self.second]
        self.words, self.at_word = np.unique(code >> np.uint64(64 - _BITS), return_inverse=True)
        self.pairs, self.at_pair = np.unique(mixed >> np.uint64(64 - _BITS), return_inverse=True)


def _chunks(df: DataFrame, keep: tuple[str, ...], text: str, flag: str, most_bytes: int, cell_bytes: int) -> DataFrame:
    """Rows of kind _DOCUMENT (the columns `keep` and `flag`, place in the chunk) and _TOKENS (all
    tokens of the chunk, in cells by place)."""
    own = [T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("place", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("a", "b", "c"))]
    names = [*(f"k{i}" for i in range(len(keep))), "flag"]
    kept = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, (*keep, flag))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "__text", most_bytes):
            flat, sizes, code = _hashed(batch.column("__text").to_pylist())
            n = batch.num_rows
            columns = [pa.array(np.full(n, number)), pa.array(np.full(n, _DOCUMENT, np.int32)), pa.array(np.arange(n)), *[pa.nulls(n, pa.binary())] * 3]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[:-1]], names=[*(f.name for f in own), *names])
            whole = _pack(flat, "<u4"), _pack(sizes, "<u4"), _pack(code, "<u8")
            cells = [tuple(w[i : i + cell_bytes] for w in whole) for i in range(0, max(map(len, whole)), cell_bytes)]
            n = len(cells)
            columns = [pa.array(np.full(n, number)), pa.array(np.full(n, _TOKENS, np.int32)), pa.array(np.arange(n)), *(pa.array(c, pa.binary()) for c in zip(*cells))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, c.type) for c in batch.columns[:-1])], names=[*(f.name for f in own), *names])
            number += 1

    rows = df.select(*[c.alias(n) for n, c in zip((*names, "__text"), columns(*keep, flag, text))])
    return rows.mapInArrow(run, T.StructType([*own, *kept]))


def _tokens_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _hashed() said of a chunk, from its rows (kind, place, a, b, c)."""
    cells = sorted((r for r in rows if r[0] == _TOKENS), key=lambda r: r[1])
    flat, sizes, code = (_unpack(b"".join(r[i] for r in cells), kind) for i, kind in ((2, "<u4"), (3, "<u4"), (4, "<u8")))
    return flat.astype(np.int64), sizes.astype(np.int64), code


def _requests(tokens: DataFrame, targets: DataFrame, ranges: tuple[int, int]) -> DataFrame:
    """(chunk, kind, a, b, c): keys of a range, ascending, with their counts in the chunk's target
    rows and in all of its rows; kind is a range of bigrams from 0 on, then the ranges of words.
    targets: chunk and place of the target rows."""

    def ask(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "place", "a", "b", "c"))))
        flat, sizes, code = _tokens_of(rows)
        mine = np.zeros(len(sizes))
        mine[[r[1] for r in rows if r[0] == _DOCUMENT]] = 1
        mine, keys = np.repeat(mine, sizes), _Keys(flat, code)
        pair_n, pair_t = np.bincount(keys.pair_of_token, minlength=len(keys.first)), np.bincount(keys.pair_of_token, mine, len(keys.first))
        word_n, word_t = np.bincount(flat, minlength=len(code)), np.bincount(flat, mine, len(code))
        kinds, packed = [], []
        for key, at, ns, ts, base, count in ((keys.pairs, keys.at_pair, pair_n, pair_t, 0, ranges[0]), (keys.words, keys.at_word, word_n, word_t, *ranges)):
            ns, ts = np.bincount(at, ns, len(key)), np.bincount(at, ts, len(key))
            part = _range_of(key, count)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                kinds.append(base + int(part[i]))
                packed.append((_pack_keys(key[i:j]), _pack(ts[i:j], "<u4"), _pack(ns[i:j], "<u4")))
        chunk = table.column("chunk")[0].as_py()
        return pa.table([pa.array([chunk] * len(kinds), pa.int64()), pa.array(kinds, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*packed))], names=["chunk", "kind", "a", "b", "c"])

    none = F.lit(None).cast("binary")
    marked = targets.select("chunk", F.lit(_DOCUMENT).alias("kind"), "place", none.alias("a"), none.alias("b"), none.alias("c"))
    both = tokens.select("chunk", "kind", "place", "a", "b", "c").unionByName(marked)
    return both.groupBy("chunk").applyInArrow(ask, "chunk long, kind int, a binary, b binary, c binary")


def _range_of(keys: np.ndarray, count: int) -> np.ndarray:
    # The upper 32 bits of a key do: ranges are far wider than what the others tell apart.
    return ((keys >> np.uint64(_BITS - 32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _answers(requests: DataFrame, first_word_range: int) -> DataFrame:
    """(chunk, kind, a, b): target and background counts of each request's keys in their order; and
    for ranges of words one row of chunk -1 whose a holds the number of words and both totals."""

    def add(table: pa.Table) -> pa.Table:
        kind, asked = table.column("kind")[0].as_py(), [_unpack_keys(x.as_py()) for x in table.column("a")]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        totals = [np.zeros(len(keys), np.int64) for _ in "tn"]
        for total, column in zip(totals, "bc"):
            np.add.at(total, at, np.concatenate([_unpack(x.as_py(), "<u4") for x in table.column(column)]).astype(np.int64))
        ends = np.cumsum([len(k) for k in asked])
        chunks = table.column("chunk").to_pylist()
        packed = [[_pack(total[at[j - len(k) : j]], "<u8") for k, j in zip(asked, ends)] for total in totals]
        if kind >= first_word_range:
            chunks.append(-1)
            packed[0].append(_pack(np.array([len(keys), *(int(t.sum()) for t in totals)]), "<u8"))
            packed[1].append(None)
        return pa.table([pa.array(chunks, pa.int64()), pa.array([kind] * len(chunks), pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=["chunk", "kind", "a", "b"])

    return requests.select("chunk", "kind", "a", "b", "c").groupBy("kind").applyInArrow(add, "chunk long, kind int, a binary, b binary")


def _losses(tokens: DataFrame, answers: DataFrame, first_word_range: int, size: dict[str, float], weight: float) -> DataFrame:
    """(chunk, place, tokens, t, b): tokens and mean losses of each document."""

    def add(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "place", "a", "b", "c"))))
        flat, sizes, code = _tokens_of(rows)
        keys, rows = _Keys(flat, code), sorted((r for r in rows if r[0] != _TOKENS), key=lambda r: r[0])
        starts = np.cumsum(sizes) - sizes
        means = []
        for column, total in ((2, size["t"]), (3, size["n"])):
            pairs, words = (np.concatenate([_unpack(r[column], "<u8") for r in rows if (r[0] >= first_word_range) == of_words]).astype(np.float64) for of_words in (False, True))
            c_pair, c_word = pairs[keys.at_pair], words[keys.at_word]
            c_first = c_word[keys.first]
            base = (c_word[keys.second] + 1) / total
            seen = weight * c_pair / np.maximum(c_first, 1) + (1 - weight) * base
            loss = -np.log(np.where(c_first > 0, seen, base))
            means.append(np.add.reduceat(loss[keys.pair_of_token], starts) / sizes)
        chunk = table.column("chunk")[0].as_py()
        return pa.table([pa.array(np.full(len(sizes), chunk)), pa.array(np.arange(len(sizes))), pa.array(sizes), *map(pa.array, means)], names=["__chunk", "__place", "size", "t", "b"])

    both = tokens.select("chunk", "kind", "place", "a", "b", "c").unionByName(answers.withColumns({"place": F.lit(0).cast("long"), "c": F.lit(None).cast("binary")}))
    return both.groupBy("chunk").applyInArrow(add, "__chunk long, __place long, size long, t double, b double")


def score_all(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", target: str = "target", weight: float = 0.6, range_bytes: int = 16 << 20, cell_bytes: int = 1 << 18, marks: DataFrame | None = None, on: str = "doc_id") -> DataFrame:
    """The columns `keep`, n_words, target_loss and background_loss (means per token) and score of
    every row; the boolean column `target` marks the rows of the target model, or marks
    (on, target) does, which is joined with the ids of the rows, not with their texts. range_bytes: text of a
    chunk, and of a range of bigrams; ranges of words are eight times as wide.
    cell_bytes: a chunk's tokens are cut into cells of this size, so that no row is of several MB."""
    spark = df.sparkSession
    keep = tuple(c for c in keep if c not in NAMES)
    total = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    ranges = (-(-total // range_bytes) or 1, -(-total // (8 * range_bytes)) or 1)
    chunks, _ = materialize(_chunks(df, keep, text, target if marks is None else on, range_bytes, cell_bytes), "lm-chunks")
    documents, tokens = chunks.where(F.col("kind") == _DOCUMENT).drop("kind", "a", "b", "c"), chunks.where(F.col("kind") == _TOKENS)
    if marks is None:
        targets = documents.where("flag")
    else:
        ids = marks.where(F.col(target)).select(F.col(on).alias("__on")).distinct()
        targets = documents.join(ids.hint("shuffle_hash"), F.col("flag") == F.col("__on"), "left_semi")
    answers, _ = materialize(_answers(_requests(tokens, targets, ranges), ranges[0]), "lm-answers")
    drop_shuffles(spark)
    found = [_unpack(r["a"], "<u8") for r in answers.where("chunk = -1").select("a").toLocalIterator()]  # one row a range of words
    words, t, n = np.sum(found, axis=0).tolist() if found else (0, 0, 0)
    losses = _losses(tokens, answers.where("chunk >= 0"), ranges[0], {"t": t + words + 1, "n": n + words + 1}, weight)
    rows = documents.join(losses, (F.col("chunk") == F.col("__chunk")) & (F.col("place") == F.col("__place")))
    kept = [f"k{i}" for i in range(len(keep))]
    return rows.select(*kept, F.col("size") - 1, "t", "b", F.col("t") - F.col("b")).toDF(*keep, *NAMES)
