"""Operator 11: byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece (a match of the tokenizer's pattern) the last token of its encoding is
stored. A token that ends there is that last token if the prefix before it is known to end in a
token next to which it stays: no merge crosses the border between the two. Exactly one token
passes, so one pass over the bytes encodes the piece, the encoding of every prefix can be read
back, more bytes can be appended, and after an edit only the bytes near it are encoded anew: once
as many prefixes as the longest token has bytes end as they did before, all later ones do.

Nulls count as empty texts, an empty text has no token, repeated rows are encoded like any other
row, and an empty table gives an empty result. Columns other than the text and those of `keep` are
ignored, whatever their names; a kept column whose name is one of the operator's own gives way.
"""

from __future__ import annotations

import base64
import bisect
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import added, bytes_of, map_texts, sliced

#: Pieces, and pairs of tokens, that a worker remembers before it starts anew.
CACHE = 1_000_000
#: A symbol, that is neither a letter, a number nor white space in any version of Unicode.
_SYMBOL = "☃"


@lru_cache(1)
def unlike_library() -> frozenset[str]:
    """Characters which the regex module counts as letters, numbers or white space and the
    library, whose Unicode tables are older, doesn't. They are found by asking both about every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    unlike: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        there = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(there.decode(there.encode_ordinary(every))), set(regex.findall(kind, every))
        if theirs - ours:
            raise ValueError(f"the regex module doesn't know all characters of {kind}")
        unlike |= ours - theirs
    return frozenset(unlike)


class Cutter:
    """Cuts texts into the matches of a pattern of letters, numbers and white space as the library does."""

    def __init__(self, pattern: str):
        self.find, self.unlike = regex.compile(pattern).findall, unlike_library()
        self.beyond = re.compile(f"[{min(self.unlike)}-\U0010ffff]") if self.unlike else None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.beyond is None or not self.beyond.search(text) or self.unlike.isdisjoint(text):
            return self.find(text)
        pieces, at = [], 0
        for piece in self.find("".join([_SYMBOL if c in self.unlike else c for c in text])):
            pieces.append(text[at : at + len(piece)])
            at += len(piece)
        return pieces


class PrefixBpe:
    """Tables of a rank file; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        if not all(bytes([b]) in self.ids for b in range(256)):
            raise ValueError("every byte must be a token")
        self.longest = max(map(len, self.tokens))
        self._stay: dict[int, bool] = {}
        #: When each token is made (-1: from the start) and of which two.
        self.made = [-1] * len(self.tokens)
        self.parts: list[tuple[int, int] | None] = [None] * len(self.tokens)
        #: Every end of a token that merges can make, and its id, or -1 if it is none itself.
        self.tails: dict[bytes, int] = {}
        for i, token in enumerate(self.tokens):
            if len(token) > 1:
                self.parts[i] = self._last_merge(i, token)
                self.made[i] = i
            if len(token) == 1 or self.parts[i] is not None:
                for at in range(1, len(token)):
                    self.tails.setdefault(token[at:], -1)
                self.tails[token] = i

    def _last_merge(self, i: int, token: bytes) -> tuple[int, int] | None:
        """The two tokens that earlier merges leave of its bytes; None if they leave more."""
        for at in range(1, len(token)):
            a, b = self.ids.get(token[:at], i), self.ids.get(token[at:], i)
            if a < i and b < i and self._usable(a) and self._usable(b) and self._untouched(a, b, i):
                return a, b
        return None

    def _usable(self, i: int) -> bool:
        return len(self.tokens[i]) == 1 or self.parts[i] is not None

    def _untouched(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank below `before` crosses the border between tokens a and b.

        Goes back in time: the later of both is undone, which shows what stood beside the border
        before. Two neighbours would have merged if that merge came before either was used up; of equal
        ranks the one further left comes first.
        """
        ids, tokens, made, parts = self.ids, self.tokens, self.made, self.parts
        while True:
            if ids.get(tokens[a] + tokens[b], before) < before:
                return False
            if made[a] > made[b]:
                before, a = made[a], parts[a][1]
            elif made[b] >= 0:
                before, b = made[b] + 1, parts[b][0]
            else:
                return True

    def stay(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b are encoded as a and b."""
        pair = a << 32 | b
        known = self._stay.get(pair)
        if known is None:
            if len(self._stay) >= CACHE:
                self._stay.clear()
            known = self._stay[pair] = self._untouched(a, b, len(self.tokens))
        return known

    def prefixes(self, data: bytes, last: list[int] | None = None, upto: int | None = None) -> list[int]:
        """The last token of every prefix of data, up to a size. `last` holds those of its first prefixes, if
        they are known; it is continued in place."""
        last = [] if last is None else last
        tail, pairs, stay = self.tails.get, self._stay.get, self.stay
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            start, found = end - 1, []
            while start >= 0 and (i := tail(data[start:end])) is not None:
                if i >= 0:
                    found.append((start, i))
                start -= 1
            for start, i in reversed(found):
                if start == 0:
                    break
                before = last[start - 1]
                known = pairs(before << 32 | i)
                if stay(before, i) if known is None else known:
                    break
            else:
                raise ValueError("no token ends here, the ranks aren't those of merges")
            last.append(i)
        return last

    def tokens_of(self, last: list[int], size: int) -> list[int]:
        """The encoding of the prefix of that size."""
        out = []
        while size:
            out.append(last[size - 1])
            size -= len(self.tokens[out[-1]])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@lru_cache(2)
def load(path: str) -> PrefixBpe:
    return PrefixBpe(path)


class Known(dict):
    """Pieces and the bytes of their ids (32 bits, little-endian). A piece that is a token itself is
    that token, whatever merges say, as in the library."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't known. In order of their bytes, each goes on from the prefix that
        it shares with the one before."""
        fresh = sorted(p.encode() for p in pieces if p not in self)
        if len(self) + len(fresh) > CACHE:
            self.clear()
            fresh = sorted(p.encode() for p in pieces)
        ids, prefixes, tokens_of = self.bpe.ids, self.bpe.prefixes, self.bpe.tokens_of
        before, last = b"", []
        for data in fresh:
            if (one := ids.get(data)) is None:
                same, most = 0, min(len(data), len(before))
                while same < most and data[same] == before[same]:
                    same += 1
                del last[same:]
                found, before = tokens_of(prefixes(data, last), len(data)), data
            else:
                found = [one]
            self[data.decode()] = array("I", found).tobytes()


@lru_cache(2)
def known_pieces(path: str) -> Known:
    """What a worker process has encoded, over all its tasks."""
    return Known(load(path))


class EditableText:
    """A text, its pieces and the last tokens of all their prefixes.

    append() and edit() give the state that the new text has, but cut and encode only what is near
    the change; `encoded_bytes` counts the prefixes that were worked out, `cut_pieces` the pieces.
    """

    #: Code points that are cut at once behind an edit.
    STEP = 4096

    def __init__(self, bpe: PrefixBpe, pattern: str, text: str = ""):
        self.bpe, self.cut, self.text = bpe, Cutter(pattern), text
        self.encoded_bytes = self.cut_pieces = 0
        self.pieces = self.cut(text)
        self.starts = np.cumsum([0, *map(len, self.pieces)])[:-1].tolist()
        self.last = [self._encoded(p) for p in self.pieces]

    def _encoded(self, piece: str) -> list[int]:
        self.cut_pieces += 1
        self.encoded_bytes += len(piece.encode())
        return self.bpe.prefixes(piece.encode())

    def _changed(self, piece: str, old: str, last: list[int]) -> list[int]:
        """Last tokens of a piece that stands where `old` stood."""
        new, was = piece.encode(), old.encode()
        same = next((i for i, (x, y) in enumerate(zip(new, was)) if x != y), min(len(new), len(was)))
        tail = next((i for i, (x, y) in enumerate(zip(new[:same - 1 if same else None:-1], was[:same - 1 if same else None:-1])) if x != y), min(len(new), len(was)) - same)
        out, back, agree, longest = last[:same], len(was) - len(new), 0, self.bpe.longest
        for end in range(same + 1, len(new) + 1):
            self.bpe.prefixes(new, out, end)
            self.encoded_bytes += 1
            inside = end > len(new) - tail + longest and end + back > longest
            agree = agree + 1 if inside and out[-1] == last[end + back - 1] else 0
            if agree >= longest:
                return out + last[end + back :]
        return out

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Put `new` in the place of the code points from start up to stop."""
        grown = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        # A piece depends on up to two code points behind it (a contraction has three), and white space on
        # the one behind the whole stretch: what ends there or later is cut anew, and the white space before that.
        first = max(0, bisect.bisect_left(self.starts, start - 2) - 1)
        while first and self.pieces[first - 1].isspace():
            first -= 1
        begin = self.starts[first] if self.starts else 0
        # Cut until a piece begins behind the edit where one began before; longer stretches if there is none.
        old_at = {s: k for k, s in enumerate(self.starts)}
        step = self.STEP
        while True:
            stretch = self.text[begin : start + len(new) + step]
            whole = begin + len(stretch) == len(self.text)
            fresh, at, end = [], begin, len(self.pieces) if whole else None
            for piece in self.cut(stretch):
                if at >= start + len(new) and at - grown in old_at and at - grown >= stop and (whole or at + len(piece) < begin + len(stretch)):
                    end = old_at[at - grown]
                    break
                fresh.append(piece)
                at += len(piece)
            if end is not None:
                break
            step *= 8
        reuse = self.pieces[first:end], self.last[first:end]
        made = []
        for k, piece in enumerate(fresh):
            if k < len(reuse[0]):
                self.cut_pieces += 1
                made.append(self._changed(piece, reuse[0][k], reuse[1][k]))
            else:
                made.append(self._encoded(piece))
        starts = np.cumsum([begin, *map(len, fresh)])[:-1].tolist() if fresh else []
        self.starts = self.starts[:first] + starts + [s + grown for s in self.starts[end:]]
        self.pieces[first:end], self.last[first:end] = fresh, made

    def ids(self) -> list[int]:
        out = []
        for piece, last in zip(self.pieces, self.last):
            known = self.bpe.ids.get(piece.encode())
            out += [known] if known is not None else self.bpe.tokens_of(last, len(last))
        return out


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns the columns of `keep`, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded bytes); with_ids adds ids (array of int) and decoded
    (binary). One pass over the input without a shuffle.
    """
    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        out += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    keep = tuple(c for c in keep if c not in {f.name for f in out})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches hold no cycles, and each collection would walk them whole
        known, cut = known_pieces(path), Cutter(pattern)
        shown = pa.array(known.bpe.tokens, pa.large_binary())
        for batch in sliced(batches, "text", 4 << 20):
            cuts = [cut(t.as_py() or "") for t in batch.column("text")]
            known.learn(set(chain.from_iterable(cuts)))
            coded = [b"".join(map(known.__getitem__, pieces)) for pieces in cuts]
            decoded = [bytes_of(shown.take(pa.array(np.frombuffer(c, "<u4"))))[1] for c in coded]
            sha = [pa.array([hashlib.sha256(x).hexdigest() for x in of], pa.string()) for of in (coded, decoded)]
            columns = [pa.array([len(c) // 4 for c in coded], pa.int64()), *sha]
            if with_ids:
                columns += [pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32())), pa.array([d.tobytes() for d in decoded], pa.binary())]
            yield added(batch, out, columns)
        gc.enable()

    return map_texts(df, keep, text, run, out)
