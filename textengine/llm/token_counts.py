"""Operator 10: token counts by trie-shared dynamic programming.

A unigram vocabulary scores a segmentation by the sum of its pieces' scores. The distinct
pre-tokens of a task go into one trie; the forward score of a node (the best segmentation of the
prefix that leads to it, and its number of pieces) follows from the nodes above it, so it is
computed once for all pre-tokens that share the prefix. Terminal nodes keep the counts, and
a document's count is the sum over its pre-tokens.

Pieces come from a sentencepiece model file, whose order is that of frequency; the score of the
piece of rank r is the logarithm of Zipf's law, -ln(r + 1) - ln(H) with H the harmonic sum. A character
that no piece covers costs its UTF-8 bytes, as byte fallback does. Ties go to fewer pieces.

Nulls and texts without words have 0 tokens; repeated rows are counted like any other row. Columns
of `keep` named like the operator's own (n_words, n_tokens) are replaced.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import added, map_texts, sliced, words_of

#: Starts every pre-token.
MARK = "▁"
#: Nodes that a task's trie may have before it is started anew.
MOST_NODES = 2_000_000


def pieces(path: str) -> dict[str, float]:
    """Scores of the normal pieces of a sentencepiece model, in the order of the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(normal))))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(normal)}


class ScoreTrie:
    """Forward scores of prefixes, shared by all words put in."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.fallback = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.best, self.count = [0.0], [0]

    def tokens(self, word: str) -> int:
        """Number of pieces of the best segmentation of a word."""
        child, best, count, scores = self.child, self.best, self.count, self.scores
        at, path = 0, [0]
        for end, c in enumerate(word, 1):
            nxt = child[at].get(c)
            if nxt is None:
                nxt = len(best)
                child[at][c] = nxt
                child.append({})
                size = len(c.encode("utf-8", "surrogatepass"))
                top, n = best[at] + self.fallback * size, count[at] + size
                for start in range(max(0, end - self.longest), end):
                    s = scores.get(word[start:end])
                    if s is not None:
                        node = path[start]
                        total, k = best[node] + s, count[node] + 1
                        if total > top or total == top and k < n:
                            top, n = total, k
                best.append(top)
                count.append(n)
            at = nxt
            path.append(at)
        return count[at]


def count_tokens(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, n_words and n_tokens of every row. One pass, no shuffle."""
    keep = tuple(c for c in keep if c not in ("n_words", "n_tokens"))
    out = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the trie holds no cycles, and each collection would walk it whole
        trie, terminal = ScoreTrie(pieces(path)), {}
        for batch in sliced(batches, "text"):
            words, totals = [], []
            for t in batch.column("text").to_pylist():
                found = words_of(t) if t else []
                if len(trie.best) > MOST_NODES:
                    trie.clear()
                    terminal = {}
                for w in sorted(set(found).difference(terminal)):
                    terminal[w] = trie.tokens(MARK + w)
                words.append(len(found))
                totals.append(sum([terminal[w] for w in found]))
            yield added(batch, out, [pa.array(words, pa.int64()), pa.array(totals, pa.int64())])
        gc.enable()

    return map_texts(df, keep, text, run, out)
