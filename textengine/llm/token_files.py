"""Operator 6: token-id files by an adaptive context-mixing range coder.

Ids are coded in blocks. A block is cut into lanes of equal length that are coded side by side
with one shared model, so that every step of the coder is a handful of numpy operations over all
lanes. The model starts anew in each block and learns from what is coded:

- order 0: frequencies of ids, quantized anew as the block grows;
- order 1 and 2: for the last id, and for a hash of the last two, the id that followed and how
  often that came true in a row;
- mixing: how often order 2 and order 1 were right, per pair of those run lengths, weighs the three.

The mixture is one integer distribution, so each id is one interval of a 64-bit range coder
that emits 32-bit words. A block holds whole rows, its header the CRC-32 of its words and of its ids,
and both are verified on reading.

The files are a table in any file system that Spark writes (one row per block, in order of part
and block), so commits, retries and lost executors are Spark's business. A null text counts as
empty and has the end id only; repeated rows are written as often as they occur; null ids come
first; an empty table gives no blocks.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bpe import Encoder, PairIndexBpe
from .common import sliced

_MAGIC, _HEADER = b"TEXR", struct.Struct("<4sQIIIII")
_BASE = 18  # bits of the order-0 distribution
_WEIGHT = 10  # bits of the mixing weights
_TOTAL = np.uint64(_BASE + _WEIGHT)
_PAIRS = 20  # bits of the order-2 table
_RUNS = 8  # run lengths that are told apart
_WORD, _HALF = np.uint64(32), np.uint64(0xFFFFFFFF)
LANES, LEAST_STEPS = 4096, 64
SCHEMA = "part int, block long, tokens_before long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


#: Run lengths are kept as 0 (nothing seen yet) to _RUNS. What follows a miss, and behind it what follows a hit.
_SPAN = _RUNS + 1
_NEXT_RUN = np.array([1, *(max(r - 1, 1) for r in range(1, _SPAN)), 1, *(min(r + 1, _RUNS) for r in range(1, _SPAN))], np.int8)
#: A cell of the mixing table is both run lengths (order 2, order 1) and whether the candidates agree.
_CELLS = 2 * _SPAN * _SPAN
_SEEN1 = (np.arange(_CELLS) // 2 % _SPAN > 0).astype(np.int32)
_SEEN2 = (np.arange(_CELLS) // 2 // _SPAN > 0).astype(np.int32)
#: Steps from one update of the mixing weights to the next.
_MIX_STEPS = 4


class _Model:
    """What both coder and decoder know after the ids coded so far."""

    def __init__(self, vocab: int):
        if vocab > 1 << (_BASE - 1):
            raise ValueError("the vocabulary is too large for the order-0 distribution")
        self.vocab = vocab
        self.counts, self.fresh = np.zeros(vocab, np.int64), []
        self.seen, self.due, self.step = 0, 0, 0
        self.next1, self.run1 = np.zeros(vocab, np.int32), np.zeros(vocab, np.int8)
        self.next2, self.run2 = np.zeros(1 << _PAIRS, np.int32), np.zeros(1 << _PAIRS, np.int8)
        self.tried, self.right1, self.right2 = np.full(_CELLS, 4.0), np.full(_CELLS, 0.4), np.full(_CELLS, 0.8)
        self.weigh()

    def weigh(self) -> None:
        """Weights of orders 1 and 2 by cell, as shares of the whole mixture; a candidate that was never seen has none."""
        scale = ((1 << _WEIGHT) - 24) / self.tried
        self.weight1 = (self.right1 * scale).astype(np.int32) * _SEEN1 << _BASE
        self.weight2 = (self.right2 * scale).astype(np.int32) * _SEEN2 << _BASE
        self.weight0 = (1 << _WEIGHT) - ((self.weight1 + self.weight2) >> _BASE)

    def order0(self) -> None:
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.vocab)
            self.fresh = []
        spare = (1 << _BASE) - self.vocab
        freq = 1 + self.counts * spare // max(1, self.seen)
        if self.seen:
            freq[int(freq.argmax())] += (1 << _BASE) - int(freq.sum())
        else:
            freq[:] = (1 << _BASE) // self.vocab
            freq[0] += (1 << _BASE) - int(freq.sum())
        self.below = (np.cumsum(freq) - freq).astype(np.int32)
        self.freq = freq.astype(np.int32)
        self.symbol = None
        self.due = self.seen + max(1, min(self.seen, 1 << 17))

    def symbols(self) -> np.ndarray:
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(self.vocab, dtype=np.int32), self.freq)
        return self.symbol

    def predict(self, last: np.ndarray, pair: np.ndarray) -> None:
        """Candidates, and weights of 2 ** _WEIGHT in all, for the next id of each lane."""
        if self.seen >= self.due:
            self.order0()
        self.last, self.pair = last, pair
        self.c1, self.r1, self.c2, self.r2 = self.next1.take(last), self.run1.take(last), self.next2.take(pair), self.run2.take(pair)
        cell = self.r2.astype(np.int16)
        cell *= _SPAN
        cell += self.r1
        cell *= 2
        cell += self.c1 == self.c2
        self.cell = cell
        self.w1, self.w2, self.w0 = self.weight1.take(cell), self.weight2.take(cell), self.weight0.take(cell)

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.hit1, self.hit2 = self.c1 == x, self.c2 == x
        low = self.w0 * self.below.take(x)
        low += self.w1 * (self.c1 < x)
        low += self.w2 * (self.c2 < x)
        wide = self.w0 * self.freq.take(x)
        wide += self.w1 * self.hit1
        wide += self.w2 * self.hit2
        return low, wide

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids that hold the places v, with their intervals."""
        low1, wide1 = self.interval(self.c1)
        low2, wide2 = self.interval(self.c2)
        up1, up2 = v >= low1 + wide1, v >= low2 + wide2
        jump = self.w1 * up1
        jump += self.w2 * up2
        x = self.symbols().take((v - jump) // self.w0, mode="clip")
        low, wide = self.w0 * self.below.take(x), self.w0 * self.freq.take(x)
        low += jump
        for at, c, lo, wi in ((np.flatnonzero((v >= low2) & ~up2), self.c2, low2, wide2), (np.flatnonzero((v >= low1) & ~up1), self.c1, low1, wide1)):
            x[at], low[at], wide[at] = c[at], lo[at], wi[at]
        self.hit1, self.hit2 = self.c1 == x, self.c2 == x
        return x, low, wide

    def learn(self, x: np.ndarray) -> np.ndarray:
        """Take in the ids of a step, after interval() or find(); returns the next pairs."""
        hit1, hit2 = self.hit1, self.hit2
        if self.step % _MIX_STEPS == 0:
            self.tried += np.bincount(self.cell, minlength=_CELLS)
            self.right2 += np.bincount(self.cell[hit2], minlength=_CELLS)
            self.right1 += np.bincount(self.cell[hit1 & ~hit2], minlength=_CELLS)
            self.weigh()
        self.step += 1
        for at, follow, runs, run, hit in ((self.last, self.next1, self.run1, self.r1, hit1), (self.pair, self.next2, self.run2, self.r2, hit2)):
            fresh = np.flatnonzero((run <= 1) > hit)
            follow[at[fresh]] = x[fresh]
            turn = hit.view(np.int8) * np.int8(_SPAN)
            turn += run
            runs[at] = _NEXT_RUN.take(turn)
        self.fresh.append(x)
        self.seen += len(x)
        mixed = self.last.view(np.uint32) * np.uint32(0x9E3779B1)
        mixed += x.view(np.uint32) * np.uint32(0x85EBCA77)
        mixed >>= np.uint32(32 - _PAIRS)
        return mixed.view(np.int32)


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block; only the last lane may be shorter."""
    steps = -(-n // min(LANES, max(1, n // LEAST_STEPS)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """A block of ids (0 <= id < vocab, one at least)."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    short = n - (lanes - 1) * steps
    model = _Model(vocab)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    last, pair = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    out_lane, out_word = [], []
    every = np.arange(lanes)
    for t in range(steps):
        m = lanes if t < short else lanes - 1
        x = grid[t, :m]
        model.predict(last[:m], pair[:m])
        start, wide = model.interval(x)
        unit = width[:m] >> _TOTAL
        lo, wi = low[:m] + start.astype(np.uint64) * unit, wide.astype(np.uint64) * unit
        need = np.flatnonzero(wi <= _HALF)
        if len(need):
            a, b = lo[need], wi[need]
            cut = ((a ^ (a + b - np.uint64(1))) >> _WORD) != 0
            b = np.where(cut, (np.uint64(0) - a) & _HALF, b)
            out_lane.append(every[need])
            out_word.append((a >> _WORD).astype(np.uint32))
            lo[need], wi[need] = a << _WORD, b << _WORD
        low[:m], width[:m] = lo, wi
        pair[:m] = model.learn(x)
        last[:m] = x
    out_lane.append(every)
    out_word.append(((low + _HALF) >> _WORD).astype(np.uint32))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    word = word[np.argsort(lane, kind="stable")].astype("<u4").tobytes()
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return _HEADER.pack(_MAGIC, n, lanes, vocab, len(word) // 4, zlib.crc32(body), crc) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block, as unsigned 32-bit integers."""
    magic, n, lanes, vocab, n_words, crc_body, crc_ids = _HEADER.unpack_from(block)
    body = memoryview(block)[_HEADER.size :]
    if magic != _MAGIC or zlib.crc32(body) != crc_body:
        raise ValueError("damaged block")
    sizes = np.frombuffer(body[: 4 * lanes], "<u4").astype(np.int64)
    words = np.concatenate((np.frombuffer(body[4 * lanes :], "<u4"), np.zeros(1, np.uint32))).astype(np.uint64)
    ends = np.cumsum(sizes)
    at = ends - sizes

    def take(which: np.ndarray) -> np.ndarray:
        got = words[np.where(at[which] < ends[which], at[which], n_words)]
        at[which] += 1
        return got

    _, steps = _shape(n)
    short = n - (lanes - 1) * steps
    model = _Model(vocab)
    every = np.arange(lanes)
    code = take(every) << _WORD
    code |= take(every)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    last, pair = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    grid = np.zeros((steps, lanes), np.uint32)
    for t in range(steps):
        m = lanes if t < short else lanes - 1
        model.predict(last[:m], pair[:m])
        unit = width[:m] >> _TOTAL
        v = np.minimum((code[:m] - low[:m]) // unit, np.uint64((1 << int(_TOTAL)) - 1)).astype(np.int32)
        x, start, wide = model.find(v)
        lo, wi = low[:m] + start.astype(np.uint64) * unit, wide.astype(np.uint64) * unit
        need = np.flatnonzero(wi <= _HALF)
        if len(need):
            a, b = lo[need], wi[need]
            cut = ((a ^ (a + b - np.uint64(1))) >> _WORD) != 0
            b = np.where(cut, (np.uint64(0) - a) & _HALF, b)
            code[need] = (code[need] << _WORD) | take(need)
            lo[need], wi[need] = a << _WORD, b << _WORD
        low[:m], width[:m] = lo, wi
        pair[:m] = model.learn(x)
        last[:m] = x
        grid[t, :m] = x
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("damaged ids")
    return ids


def write_files(df: DataFrame, target: str, tokenizer: str, end_id: int = 2, block_tokens: int = 1 << 21, key: str = "doc_id", text: str = "text") -> None:
    """Encode the texts of df in ascending order of `key`, end_id after each, and write blocks
    of whole rows with about block_tokens ids (at least one row) to `target`."""
    ordered = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches hold no cycles, and each collection would walk them whole
        part, bpe = TaskContext.get().partitionId(), PairIndexBpe(tokenizer)
        encoder, vocab = Encoder(bpe, ("words",)), max(max(bpe.tokens), end_id) + 1
        block, before = 0, 0
        keys, lengths, ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            flat, n = np.concatenate(ids), np.concatenate(lengths)
            one = [pa.array([v], k) for v, k in ((part, pa.int32()), (block, pa.int64()), (before, pa.int64()), (len(flat), pa.int64()))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), v) for v in (pa.concat_arrays(keys), pa.array(n))]
            block, before = block + 1, before + len(flat)
            keys.clear(), lengths.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([*one, *lists, pa.array([encode_block(flat, vocab)], pa.binary())], names=[c.split()[0] for c in SCHEMA.split(", ")])

        held = 0
        for batch in sliced(batches, "text", 8 << 20):
            counts, shown = encoder.run(batch.column("text"))
            n = counts + 1
            ends = np.cumsum(n)
            flat = np.full(int(ends[-1]), end_id, np.uint32)
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = np.frombuffer(shown["words"][1], "<u4")
            at = 0
            while at < len(n):  # whole rows until the block has enough ids
                upto = min(len(n), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_tokens - held)) + 1)
                keys.append(batch.column("key").slice(at, upto - at))
                lengths.append(n[at:upto])
                ids.append(flat[ends[at] - n[at] : ends[upto - 1]])
                held += len(ids[-1])
                at = upto
                if held >= block_tokens:
                    yield flush()
                    held = 0
        if ids:
            yield flush()
        gc.enable()

    ordered.mapInArrow(run, SCHEMA).write.parquet(target)


def read_files(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """Per row of the files: key, start (ids of all rows before it), n_tokens, ids_crc32 and,
    with_ids, the ids themselves. Damaged blocks fail the job."""
    blocks = spark.read.schema(SCHEMA).parquet(target)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per written file part.
    starts = parts.select(F.col("part").alias("of"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    rows = blocks.join(starts, F.col("part") == F.col("of"))
    rows = rows.select((F.col("part_start") + F.col("tokens_before")).alias("start"), "doc_ids", "lengths", "payload")
    names = ["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, keys, lengths, payload = (batch.column(c)[i] for c in range(4))
                ids = decode_block(payload.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                cuts = list(zip((ends - n).tolist(), ends.tolist()))
                columns = [pa.array(keys.as_py(), pa.int64()), pa.array(ends - n + start.as_py()), pa.array(n), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in cuts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in cuts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
