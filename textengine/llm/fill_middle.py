"""Operator 12: fill-in-middle transformation by secondary sort.

A text's units are cut into pieces of `units` units, keyed by document and place in the output. One
exchange by document with a sort by place inside the partitions (repartitionAndSortWithinPartitions,
in its DataFrame form, so the sort spills in the JVM) lets each task read a document's output as a
stream of pieces, which goes into a running digest. The stream's sentinels tell which part each
piece belongs to; sorted again by its place in the text, inside the same partitions and without
another exchange, the pieces go into the digest of the restored text. After the cut no task holds
more of a document than a piece, unless the texts themselves are asked for.

A null text counts as empty, an empty text is plain, and a null id takes the place of its digits as the empty
string. Repeated rows give a row each; rows of equal id and text share their pieces. An empty table gives
an empty result. Columns other than the text, the id and those of `keep` are ignored, whatever
their names; a kept column whose name is one of the operator's own gives way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, columns, sliced

#: Fixed values of the format: sentinels of prefix, suffix and middle.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
_SENTINEL = re.compile(b"<[PSM]>")
_PART = {s: part for part, s in SENTINELS.items()}
_BEGUN = {n: {s[:n] for s in SENTINELS.values()} for n in (1, 2)}
#: Order of the parts in an output, and in the text.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
TEXT_ORDER = ("prefix", "middle", "suffix")
OWN = ("n", "form", "prefix_chars", "middle_chars")
#: Places of a part's pieces begin at its number times this.
_FAR = 1 << 40
#: Place of the row that holds what the result says of a document.
_HEAD = -1


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of several texts: at each code point but a letter after a letter."""
    letter = ((raw | 32) - np.uint8(97)) < 26
    begins = (raw & 0xC0) != 0x80
    inner = letter[1:] & letter[:-1]
    inner[offsets[(offsets > 0) & (offsets < len(raw))] - 1] = False
    begins[1:] &= ~inner
    return np.flatnonzero(begins)


def drawn(doc_id, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


class Parts:
    """Tells the parts of an output, piece after piece; a sentinel may stand across pieces."""

    def __init__(self) -> None:
        self.part, self.rest = TEXT_ORDER[0], b""

    def feed(self, piece: bytes) -> Iterator[tuple[str, bytes]]:
        piece, self.rest = self.rest + piece, b""
        at = 0
        for hit in _SENTINEL.finditer(piece):
            yield self.part, piece[at : hit.start()]
            self.part, at = _PART[hit[0]], hit.end()
        end = len(piece) - next((n for n in (2, 1) if piece[max(at, len(piece) - n) :] in _BEGUN[n]), 0)
        self.rest = piece[end:]
        yield self.part, piece[at:end]

    def close(self) -> tuple[str, bytes]:
        return self.part, self.rest


def _pieces(inner: list[str], units: int, seed: int, plain_from: int, spm_below: int):
    """Rows of (key, place, piece, head): for each text one with a head, and its pieces in output order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in sliced(batches, "text", 4 << 20):
            ids = batch.column("id").to_pylist()
            offsets, raw = bytes_of(batch.column("text"))
            starts = unit_starts(raw, offsets)
            lead = (raw & 0xC0) != 0x80
            bounds, ends = np.searchsorted(starts, offsets).tolist(), offsets.tolist()
            data = raw.tobytes()
            keys, places, pieces, said = [], [], [], []
            head_keys = []
            for k, doc_id in enumerate(ids):
                low, high = ends[k], ends[k + 1]
                text = data[low:high]
                at = np.append(starts[bounds[k] : bounds[k + 1]], high)
                n = len(at) - 1
                # Rows of one task only share a key, however many copies there are in all.
                key = hashlib.blake2b(f"{task}:{doc_id}:".encode() + text, digest_size=16).digest()
                h1, h2, h3, h4 = drawn(doc_id, seed)
                one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                if n == 0 or h3 % 100 >= plain_from or _SENTINEL.search(text):
                    form, order, cuts = "plain", (None,), {None: (0, n)}
                    said.append((n, form, None, None))
                else:
                    form = "spm" if h4 % 100 < spm_below else "psm"
                    order, cuts = FORMS[form], {"prefix": (0, one), "middle": (one, two), "suffix": (two, n)}
                    said.append((n, form, int(lead[low : at[one]].sum()), int(lead[at[one] : at[two]].sum())))
                head_keys.append(key)
                place = 0
                for part in order:
                    mark, (i, j) = SENTINELS.get(part, b""), cuts[part]
                    while mark or i < j:
                        keys.append(key)
                        places.append(place)
                        pieces.append(mark + data[at[i] : at[min(i + units, j)]])
                        mark, i, place = b"", i + units, place + 1
            own = list(zip(*said)) or [()] * 4
            columns = [*batch.columns[2:], *(pa.array(v, t) for v, t in zip(own, (pa.int64(), pa.string(), pa.int64(), pa.int64())))]
            heads = pa.StructArray.from_arrays(columns, names=[*inner, *OWN])
            yield _rows(head_keys, [_HEAD] * len(ids), [None] * len(ids), heads)
            yield _rows(keys, places, pieces, pa.nulls(len(keys), heads.type))

    return run


def _rows(keys: list, places: list, pieces: list, heads: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(keys, pa.binary()), pa.array(places, pa.int64()), pa.array(pieces, pa.binary()), heads]
    return pa.RecordBatch.from_arrays(columns, names=["key", "place", "piece", "head"])


class _Stream:
    """Reads rows sorted by key and place: digests each key's pieces and gives its heads the digest.

    finished() takes heads, their digests and their texts. relabel gives the pieces on, under their places in the text.
    """

    def __init__(self, with_text: bool):
        self.with_text = with_text
        self.key = None
        self.held: list[pa.Array] = []
        self._begin(None)

    def _begin(self, key) -> None:
        self.key, self.seen = key, _HEAD
        self.sha, self.text, self.parts, self.count = hashlib.sha256(), [], None, {}

    def run(self, batches: Iterator[pa.RecordBatch], finished, relabel: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, pieces, heads = batch.column("key").to_pylist(), batch.column("place").to_pylist(), batch.column("piece").to_pylist(), batch.column("head")
            forms = heads.field(heads.type.get_field_index("form")) if relabel else None
            mine: list[int] = []
            done: tuple[list, list, list] = ([], [], [])  # rows of heads, digests, texts
            moved: tuple[list, list, list] = ([], [], [])  # keys, places in the text, pieces
            for i, (key, place) in enumerate(zip(keys, places)):
                if key != self.key:
                    yield from self._close(mine, done, moved, finished)
                    self._begin(key)
                    mine = []
                if place == _HEAD:
                    mine.append(i)
                    if relabel and self.parts is None and forms[i].as_py() != "plain":
                        self.parts = Parts()
                elif place != self.seen:  # else the piece of a repeated row
                    self.seen = place
                    self.sha.update(pieces[i])
                    if self.with_text:
                        self.text.append(pieces[i])
                    if relabel:
                        for part, piece in self.parts.feed(pieces[i]) if self.parts else [(TEXT_ORDER[0], pieces[i])]:
                            self._move(moved, part, piece)
            if mine:
                self.held.append(heads.take(pa.array(mine)))
            if done[0]:
                yield from finished(heads.take(pa.array(done[0])), done[1], done[2])
            if moved[0]:
                yield _moved(*moved, heads.type)
        if self.held:
            head, moved = self.held[0].type, ([], [], [])
            yield from self._close([], ([], [], []), moved, finished)
            if moved[0]:
                yield _moved(*moved, head)

    def _move(self, moved, part: str, piece: bytes) -> None:
        if piece:
            at = self.count[part] = self.count.get(part, -1) + 1
            for column, value in zip(moved, (self.key, TEXT_ORDER.index(part) * _FAR + at, piece)):
                column.append(value)

    def _close(self, mine: list[int], done, moved, finished) -> Iterator[pa.RecordBatch]:
        """The end of a key: its heads of this batch go to done, those of batches before are given out."""
        digest, text = self.sha.hexdigest(), b"".join(self.text) if self.with_text else None
        if self.parts:
            self._move(moved, *self.parts.close())
        done[0].extend(mine)
        done[1].extend([digest] * len(mine))
        done[2].extend([text] * len(mine))
        for heads in self.held:
            yield from finished(heads, [digest] * len(heads), [text] * len(heads))
        self.held = []


def _moved(keys: list, places: list, pieces: list, head: pa.DataType) -> pa.RecordBatch:
    nulls = [pa.nulls(len(keys), t) for t in (pa.string(), pa.binary())]
    rows = _rows(keys, places, pieces, pa.nulls(len(keys), head))
    return pa.RecordBatch.from_arrays([*rows.columns, *nulls], names=[*rows.schema.names, "digest", "output"])


def _inside(batches: Iterator[pa.RecordBatch], **more: str) -> Iterator[pa.RecordBatch]:
    """Heads with other columns of their rows inside, so that they can be given out later."""
    for batch in batches:
        head = batch.column("head")
        columns = [*(head.field(i) for i in range(head.type.num_fields)), *(batch.column(c) for c in more.values())]
        heads = pa.StructArray.from_arrays(columns, names=[*(f.name for f in head.type), *more])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("place"), batch.column("piece"), heads], names=["key", "place", "piece", "head"])


def _output(with_text: bool):
    """The digest of each output, and its pieces under their places in the text."""

    def finished(heads: pa.Array, digests: list, texts: list) -> Iterator[pa.RecordBatch]:
        keys = heads.field(heads.type.get_field_index("of"))
        rest = [pa.array([_HEAD] * len(heads), pa.int64()), pa.nulls(len(heads), pa.binary()), heads, pa.array(digests, pa.string()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays([keys, *rest], names=["key", "place", "piece", "head", "digest", "output"])

    return lambda batches: _Stream(with_text).run(_inside(batches, of="key"), finished, True)


def fill_in_middle(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), units: int = 2048, seed: int = 1, plain_from: int = 90, spm_below: int = 20, with_text: bool = False
) -> DataFrame:
    """Move a random middle of each text behind its suffix, and restore the text from the result.

    A text of n units is cut at two places drawn from the hash of seed and id. Plain ones stay as they are:
    empty texts, those with a sentinel, and plain_from to 99 of a hundred. spm_below of a hundred
    others begin with the suffix.

    Returns the columns of `keep`, n, form, prefix_chars, middle_chars, output_sha256 and
    restored_sha256; with_text adds output and restored (string), for which a task holds one document at a time.
    """
    own = [T.StructField(n, T.StringType() if n == "form" else T.LongType()) for n in OWN]
    digests = ["output_sha256", "restored_sha256", *(["output", "restored"] if with_text else [])]
    keep = tuple(c for c in keep if c not in {*(f.name for f in own), *digests})
    inner = [f"c{i}" for i in range(len(keep))]
    fields = [T.StructField(n, df.schema[c].dataType) for n, c in zip(inner, keep)]
    head = T.StructType([*fields, *own])
    key, place, piece = T.StructField("key", T.BinaryType()), T.StructField("place", T.LongType()), T.StructField("piece", T.BinaryType())
    cut_schema = T.StructType([key, place, piece, T.StructField("head", head)])
    with_key = T.StructType([*head.fields, T.StructField("of", T.BinaryType())])
    out_schema = T.StructType([key, place, piece, T.StructField("head", with_key), T.StructField("digest", T.StringType()), T.StructField("output", T.BinaryType())])
    last_schema = T.StructType([*head.fields, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType()), T.StructField("output", T.StringType()), T.StructField("restored", T.StringType())])

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(head.fields)

        def finished(heads: pa.Array, found: list, texts: list) -> Iterator[pa.RecordBatch]:
            at = heads.type.get_field_index
            outputs = heads.field(at("output")).cast(pa.string())
            columns = [*(heads.field(i) for i in range(n)), heads.field(at("digest")), pa.array(found, pa.string()), outputs, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=last_schema.names)

        return _Stream(with_text).run(_inside(batches, digest="digest", output="output"), finished, False)

    id_of, text_of = columns(doc_id, text)
    rows = df.select(id_of.alias("id"), F.coalesce(text_of, F.lit("")).alias("text"), *[c.alias(n) for n, c in zip(inner, columns(*keep))])
    cut = rows.mapInArrow(_pieces(inner, units, seed, plain_from, spm_below), cut_schema)
    outputs = cut.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_output(with_text), out_schema)
    found = outputs.sortWithinPartitions("key", "place").mapInArrow(restored, last_schema)
    names = [*keep, *(f.name for f in own), *digests]
    return found.select(*inner, *(f.name for f in own), *digests).toDF(*names)
