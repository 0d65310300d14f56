"""Operator 2: BPE encoding and decoding with a pair occurrence index.

A batch's texts are cut into pre-tokens on their bytes, and each distinct pre-token gets a number.
The distinct ones that a task has not met yet are laid out as one array of symbols. Every adjacent
pair that has a merge is filed with its position under the merge's rank; the active ranks are
applied in ascending order, and each merge files the pairs it creates. Rare ranks share a window
of neighbouring ranks, in which each pre-token's least rank is applied first, so the order within
every pre-token is the ascending one. Whole texts are put together from their numbers.

Byte rules cover ASCII and the Latin letters of U+00C0 to U+00FF. Chunks between blanks that hold anything else, a
contraction or a special token are normalized and cut by the library itself, once per distinct chunk; only merges are made here.

Nulls count as empty texts, an empty text has no token, and repeated rows are encoded like
any other row. Extra columns are ignored by encode_decode() except those named in `keep`; a kept
column whose name is one of the operator's own gives way to it.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import added, bytes_of, map_texts, sliced

#: Distinct pre-tokens that a task keeps before it starts its cache anew.
CACHE_UNITS = 1_000_000
#: Pairs that share a window of ranks.
_WINDOW = 4096
#: Bytes of words that share an index.
_BLOCK = 1 << 20

_BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _classes() -> np.ndarray:
    """Class of each byte; letters beyond ASCII are a byte C3 and one from 80 to BF."""
    kinds = np.full(256, _ODD, np.uint8)
    kinds[33:127] = _OTHER
    kinds[[9, 10, 11, 12, 13, 32]] = _BLANK
    for first, last in ("AZ", "az"):
        kinds[ord(first) : ord(last) + 1] = _LETTER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[0x80:0xC0] = kinds[0xC3] = _LETTER
    kinds[ord("'")] = _ODD
    return kinds


_KINDS = _classes()
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


def _binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches flat[starts[c] : starts[c] + counts[c]] of all codes, one after another."""
    n = counts[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(total)]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pre-tokens of all texts in lower case, one after another; which are odd, that is whole
    chunks as they stand in the text, which the byte rules don't cover; and the number of
    pre-tokens before each text's end."""
    closed = pc.binary_join_element_wise(texts.fill_null("").cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    offsets, raw = bytes_of(closed)
    kinds = _KINDS[raw]
    low = _SMALL[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
    follow = raw[latin]
    low[latin[(follow >= 0x80) & (follow <= 0x9E)]] += 0x20
    kinds[latin[(follow == 0x97) | (follow == 0xB7)]] = _ODD
    kinds[np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))] = _ODD
    solid = kinds != _BLANK
    edge = np.empty(len(raw), bool)
    edge[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    edge |= kinds == _DIGIT
    edge &= solid
    starts = np.flatnonzero(edge)
    fresh = np.concatenate(([True], ~solid))[starts]  # a chunk begins after a blank
    odd_at = np.flatnonzero(kinds == _ODD)
    odd = np.zeros(len(starts), bool)
    if len(odd_at):
        heads = np.flatnonzero(fresh)
        chunk_odd = np.zeros(len(heads), bool)
        chunk_odd[np.searchsorted(starts[heads], odd_at, "right") - 1] = True
        inside = chunk_odd[np.cumsum(fresh) - 1]
        stay = fresh | ~inside
        starts, odd, heads = starts[stay], inside[stay], starts[heads[chunk_odd]]
        blanks = np.flatnonzero(~solid)
        sizes = blanks[np.searchsorted(blanks, heads)] - heads
        back = np.repeat(heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        low[back] = raw[back]
    bounds = np.searchsorted(starts, offsets[1:])
    place = np.cumsum(solid, dtype=np.int64)
    units = np.concatenate((place[starts] - 1, place[-1:] if len(place) else [0]))
    return _binary(units, low[solid]), odd, bounds


def _cut_in_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """cut() in slices whose working arrays stay small."""
    found, before = [], 0
    for part in sliced(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), "t", most_bytes):
        units, odd, bounds = cut(part.column(0))
        found.append((units, odd, bounds + before))
        before += len(units)
    if not found:
        return pa.array([], pa.large_binary()), np.zeros(0, bool), np.zeros(0, np.int64)
    units, odd, bounds = zip(*found)
    return pa.concat_arrays(units), np.concatenate(odd), np.concatenate(bounds)


class PairIndexBpe:
    """Encoder and decoder of a BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        library = Tokenizer.from_file(path)
        self.normal, self.cut_up = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.ascii_cut = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        #: Two ids side by side make a pair's key; 32 bits do if ids have 16.
        self.narrow = max(self.tokens) < 1 << 16
        keys = self._key(self.left, self.right)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        self.first_rank = None
        if max(self.inner.max(), self.last.max()) < 512:  # a table for the pairs of letters
            self.first_rank = np.full(1 << 18, -1, np.int32)
            low = (self.left < 512) & (self.right < 512)
            self.first_rank[(self.left[low] << 9) | self.right[low]] = np.flatnonzero(low)
        # A merge may only create pairs of later ranks, else ascending ranks would miss some.
        born = np.full(max(self.tokens) + 1, -1, np.int64)
        born[self.made] = np.arange(len(pairs))
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("merges must use only tokens of earlier merges")
        texts = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        #: Every id as it is shown with a blank behind it: its number, its token and its four bytes.
        self.shown = {"ids": [f"{i} ".encode() for i in range(len(texts))], "decoded": [f"{t} ".encode() for t in texts], "words": [i.to_bytes(4, "little") for i in range(len(texts))]}
        self.shown = {k: pa.array(v, pa.large_binary()) for k, v in self.shown.items()}

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32) if self.narrow else (a.astype(np.int64) << 32) | b

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self._key(a, b)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_rank[at], np.int32(-1))

    def merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words whose bytes stand in raw, one after another, and the count of each
        (sizes: bytes of each, 1 at least). Indexed in blocks of words, so that what merges touch stays in the processor's cache."""
        ends = np.cumsum(sizes)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, len(raw), _BLOCK), "right")).tolist()
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for i, j in zip(cuts, [*cuts[1:], len(sizes)]):
            first = int(ends[i - 1]) if i else 0
            parts.append(self._merge(raw[first : int(ends[j - 1])], sizes[i:j]))
        flat, counts = zip(*parts)
        return np.concatenate(flat), np.concatenate(counts)

    def _merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes) - 1
        symbol = self.inner[raw]
        symbol[ends] = self.last[raw[ends]]
        n = len(symbol)
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends[:-1] + 1] = -1
        rank = self.first_rank[(symbol[:-1] << 9) | symbol[1:]] if self.first_rank is not None else self._rank(symbol[:-1], symbol[1:])
        at = np.flatnonzero((rank >= 0) & (after[:-1] >= 0)).astype(np.int32)
        rank = rank[at]
        # Windows of ranks: about _WINDOW pairs each by the first counts and a share of those to come.
        load = np.bincount(rank, minlength=len(self.made)) + n / len(self.made)
        window = ((np.cumsum(load) - load / 2) // max(_WINDOW, load.sum() / 60_000)).astype(np.uint16)
        filed: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(int(window[-1]) + 1)]

        def file(at: np.ndarray, rank: np.ndarray) -> None:
            w = window[rank]
            order = np.argsort(w, kind="stable")
            at, rank, w = at[order], rank[order], w[order]
            cuts = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(at)]
            for k, i, j in zip(w[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]):
                filed[k].append((at[i:j], rank[i:j]))

        if len(at):
            file(at, rank)
        for k in range(len(filed)):
            found, filed[k] = filed[k], []
            while found:
                at, rank = (found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found)))
                found = []
                nxt = after[at]
                ok = (symbol[at] == self.left[rank]) & (nxt >= 0) & (symbol[nxt] == self.right[rank])
                at, rank = at[ok], rank[ok]
                if len(at) == 0:
                    break
                # By place; the least rank of each word goes first, and the others of the window wait.
                both = np.sort((at.astype(np.int64) << 20) | rank)
                both = both[np.diff(both, prepend=-1) != 0]
                at, rank = (both >> 20).astype(np.int32), (both & 0xFFFFF).astype(np.int32)
                nxt, w = after[at], word[at]
                first = np.flatnonzero(np.diff(w, prepend=-1))
                now = rank == np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(w)))
                if not now.all():
                    found.append((at[~now], rank[~now]))
                    at, rank, nxt = at[now], rank[now], nxt[now]
                joint = at[1:] == nxt[:-1]
                if joint.any():  # in a run of one symbol every second pair merges
                    new_run = np.concatenate(([True], ~joint))
                    in_run = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                    even = in_run % 2 == 0
                    at, rank, nxt = at[even], rank[even], nxt[even]
                beyond = after[nxt]
                symbol[at], symbol[nxt], after[at] = self.made[rank], -1, beyond
                has = beyond >= 0
                before[beyond[has]] = at[has]
                left = before[at]
                touched = np.concatenate((left[left >= 0], at[has]))
                rank = self._rank(symbol[touched], symbol[after[touched]])
                touched, rank = touched[rank >= 0], rank[rank >= 0]
                if len(touched):
                    file(touched, rank)
                    found += filed[k]
                    filed[k] = []
        alive = symbol >= 0
        return symbol[alive], np.add.reduceat(alive, ends - sizes + 1, dtype=np.int64)

    def parts(self, chunk: str) -> list:
        """Of a chunk that the rules for bytes don't cover: pre-tokens as bytes, special tokens as ids."""
        if self.special_pattern is None or not (hit := self.special_pattern.search(chunk)):
            if chunk.isascii():
                return [p.encode() for p in self.ascii_cut(chunk.lower())]
            return [bytes([self.byte_of[c] for c in piece]) for piece, _ in self.cut_up(self.normal(chunk))]
        head, tail = chunk[: hit.start()], chunk[hit.end() :]
        return [*(self.parts(head) if head else []), self.special[hit[0]], *(self.parts(tail) if tail else [])]

    def encode_units(self, units: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units of cut() one after another, and the count of each."""
        offsets, raw = bytes_of(units)
        sizes = np.diff(offsets)
        if not odd.any():
            return self.merge(raw, sizes)
        index: dict = {}
        found = [self.parts(u.decode()) for u in units.filter(pa.array(odd)).to_pylist()]
        codes = np.array([index.setdefault(p, len(index)) for ps in found for p in ps], np.int64)
        words = [b"" if type(w) is int else w for w in index]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        is_word = lengths > 0
        plain_bytes = raw[np.repeat(~odd, sizes)]
        flat, counts = self.merge(np.concatenate((plain_bytes, np.frombuffer(b"".join(words), np.uint8))), np.concatenate((sizes[~odd], lengths[is_word])))
        # Numbers of what was merged: plain units, then the words of odd ones, then special ids.
        plain = int((~odd).sum())
        number = np.zeros(len(words), np.int64)
        number[is_word] = plain + np.arange(int(is_word.sum()))
        number[~is_word] = len(counts) + np.arange(int((~is_word).sum()))
        special = np.array([w for w in index if type(w) is int], np.int32)
        flat, counts = np.concatenate((flat, special)), np.concatenate((counts, np.ones(len(special), np.int64)))
        of_unit = np.ones(len(units), np.int64)
        of_unit[odd] = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(of_unit)
        order = np.zeros(int(ends[-1]), np.int64)
        from_odd = np.repeat(odd, of_unit)
        order[from_odd], order[~from_odd] = number[codes], np.arange(plain)
        upto = np.concatenate(([0], np.cumsum(counts[order])))
        return gather(flat, np.cumsum(counts) - counts, counts, order), upto[ends] - upto[ends - of_unit]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(Encoder(self, ("words",)).run(pa.array([text]))[1]["words"][1], "<u4").tolist()

    def decode(self, ids) -> str:
        """The file names no decoder, so tokens are joined by one blank."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


class Encoder:
    """Encodes batches of texts and keeps the distinct pre-tokens of those before.

    forms: how ids are given back, keys of PairIndexBpe.shown.
    """

    def __init__(self, bpe: PairIndexBpe, forms: tuple[str, ...]):
        self.bpe, self.forms = bpe, forms
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.counts = np.zeros(0, np.int64)
        self.shown = {f: pa.array([], pa.large_binary()) for f in self.forms}

    def run(self, texts: pa.Array) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
        """The number of tokens of each text, and for each form the place where each text begins
        (and the last one ends) in the bytes of all."""
        units, odd, bounds = _cut_in_slices(texts)
        coded = units.dictionary_encode()
        fresh, codes = coded.dictionary, coded.indices.to_numpy()
        fresh_odd = np.zeros(len(fresh), bool)
        fresh_odd[codes[odd]] = True
        if len(self.known) + len(fresh) > CACHE_UNITS:
            self._forget()
        number = np.arange(len(fresh))
        if len(self.known):
            met = pc.index_in(fresh, value_set=self.known)
            new = np.asarray(pc.is_null(met))
            number = np.asarray(met.fill_null(0)).astype(np.int64)
            number[new] = len(self.known) + np.arange(int(new.sum()))
            fresh, fresh_odd = fresh.filter(pa.array(new)), fresh_odd[new]
        flat, counts = self.bpe.encode_units(fresh, fresh_odd)
        ends = np.concatenate(([0], np.cumsum(counts)))
        self.known, self.counts = pa.concat_arrays([self.known, fresh]), np.concatenate((self.counts, counts))
        for f in self.forms:
            offsets, data = bytes_of(self.bpe.shown[f].take(pa.array(flat)))
            self.shown[f] = pa.concat_arrays([self.shown[f], _binary(offsets[ends], data)])
        codes = number[codes]
        upto = np.concatenate(([0], bounds))
        total = np.concatenate(([0], np.cumsum(self.counts[codes])))
        out = {}
        for f in self.forms:
            offsets, data = bytes_of(self.shown[f].take(pa.array(codes)))
            out[f] = offsets[upto], data
        return np.diff(total[upto]), out


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the columns of `keep`, n_tokens, ids_sha256 and decoded_sha256; with_text adds
    ids (array of int) and decoded (string). One pass over the input without a shuffle.
    """
    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_text:
        out += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    keep = tuple(c for c in keep if c not in {f.name for f in out})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches hold no cycles, and each collection would walk them whole
        encoder = Encoder(PairIndexBpe(path), ("ids", "decoded"))
        for batch in sliced(batches, "text", 4 << 20):
            counts, shown = encoder.run(batch.column("text"))
            said = {}
            for form, (at, data) in shown.items():
                view, at = memoryview(data), at.tolist()
                said[form] = [view[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:])]  # without the last blank
            sha = [pa.array([hashlib.sha256(v).hexdigest() for v in said[form]], pa.string()) for form in ("ids", "decoded")]
            columns = [pa.array(counts, pa.int64()), *sha]
            if with_text:
                ids = [[int(i) for i in bytes(v).split()] for v in said["ids"]]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([bytes(v).decode() for v in said["decoded"]], pa.string())]
            yield added(batch, out, columns)
        gc.enable()

    return map_texts(df, keep, text, run, out)
