"""Sparse vectors in blocks: every block of queries meets every block of a pool once, without a row per pair.

A block is one row that holds many sparse vectors as packed arrays, a pool's block its inverted index. The blocks of
both sides are written once and their cross product is streamed: a task holds a few blocks of queries and meets the
pool's blocks one after the other, so what is shuffled are a query's best of a few large parts of the pool, not the
pairs that share a term. Terms that many rows of both blocks have are summed by a matrix product, the others by their
postings. The product is of single precision and only tells which pairs may count; these get whole sums. From a threshold on,
the lengths of what rows have in common terms bound the product, which is then not needed. A set with itself meets each
pair of blocks once. Terms stand under hashes of 64 bits (10^8 different terms share one with probability 0.0003).

Arrays are stored as zstd over the planes of their bytes, integers as differences. A weight that is a product of one
number of the posting (of which there are few), one of its term and one of its row is stored as these three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textengine.scratch import BATCH, drop_table, materialize

PLACES = 6
#: Postings of a block, 12 bytes each in memory; of TF-IDF about 3 as stored.
POSTINGS = 1 << 21
#: Postings of a block that is merged of others: larger blocks of a pool meet faster.
MERGED = 1 << 20
#: Products and cells that a task sums up at a time.
CELLS = 1 << 21
#: A term goes into the matrix product if this share of the pairs of rows has it; so many terms and cells of a matrix at most.
DENSE, MOST_DENSE, DENSE_CELLS = 0.003, 1024, 1 << 22
#: What sums of single precision may be off by, as a share; no weight is less than _SMALL there.
_OFF, _SMALL = 1e-4, 1e-18
#: Rows of results that a block of queries holds until they are cut down to the best.
HELD = 1 << 18
#: Tasks for each core, as far as the pool has to be parted for that.
TASKS = 3
#: A weight of 0 still links rows that share its term.
_LEAST = 1e-150
NAMES = ["block", "ids", "counts", "keys", "at", "w", "idf", "norm"]
BLOCK = "block long, ids binary, counts binary, keys binary, at binary, w binary, idf binary, norm binary"
_ZSTD = pa.Codec("zstd")


def shrunk(x: np.ndarray) -> bytes:
    """An array as bytes: its length, and its planes of bytes (of the differences, for integers) compressed."""
    x = np.ascontiguousarray(x)
    if x.dtype.kind == "i":
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return np.int64(len(x)).tobytes() + _ZSTD.compress(pa.py_buffer(planes), asbytes=True)


def grown(data: bytes | memoryview | pa.Buffer, kind: type) -> np.ndarray:
    """The array of shrunk()."""
    data = memoryview(data)
    n, size = int(np.frombuffer(data[:8], np.int64)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(pa.py_buffer(data[8:]), n * size), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if x.dtype.kind == "i" else x


def packed_row(block: int, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, w: np.ndarray, index: bool, idf: np.ndarray | None = None, norm: np.ndarray | None = None) -> pa.RecordBatch:
    """A block of rows that stand one after the other, with their numbers of terms. A query block has, by row, numbers
    into its distinct terms (keys) and the rows' lengths (counts); a pool block has, by term, the rows' numbers and the
    terms' lengths. idf (by posting) and norm (by row): w is to be multiplied by the one and divided by the other."""
    order = np.argsort(ids, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    ids, sizes = ids[order], sizes[order]
    take = np.arange(len(terms)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    keys, code = np.unique(terms[take], return_inverse=True)
    rows, of_key, of_row = np.repeat(np.arange(len(ids)), sizes), np.zeros(0), np.zeros(0)
    if idf is not None:
        of_key, of_row = np.zeros(len(keys)), norm[order]
        of_key[code] = idf[take]
    put = np.argsort(code, kind="stable") if index else np.lexsort((code, rows))
    at, counts = (rows, np.bincount(code, minlength=len(keys))) if index else (code, sizes)
    parts = ids.astype(np.int64), counts.astype(np.int32), keys, at[put].astype(np.int32), w[take][put], of_key, of_row
    return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([shrunk(x)], pa.binary()) for x in parts)], NAMES)


class _Block:
    """A block's arrays, with whole weights: of queries, or (index) of a pool."""

    def __init__(self, row: dict, index: bool):
        read = lambda name, kind: grown(row[name], kind)
        self.ids, self.counts, self.keys, self.at = read("ids", np.int64), read("counts", np.int32).astype(np.int64), read("keys", np.int64), read("at", np.int32)
        w, idf, norm = (read(name, np.float64) for name in ("w", "idf", "norm"))
        if len(norm):
            key, of = (np.repeat(np.arange(len(self.keys)), self.counts), self.at) if index else (self.at, np.repeat(np.arange(len(self.ids)), self.counts))
            w = w * idf[key] / norm[of]
        self.w = np.maximum(w, _LEAST)

    def inverted(self) -> _Block:
        """A block of queries as one of a pool."""
        order = np.argsort(self.at, kind="stable")
        rows = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.counts)[order]
        self.at, self.counts, self.w = rows, np.bincount(self.at, minlength=len(self.keys)), self.w[order]
        return self


def block_ids(blocks: DataFrame) -> DataFrame:
    """(id) of the rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in batch.column("ids"):
                yield pa.RecordBatch.from_arrays([pa.array(grown(ids.as_buffer(), np.int64))], ["id"])

    return blocks.select("ids").mapInArrow(run, "id long")


def packed(rows: DataFrame, index: bool, postings: int = POSTINGS) -> DataFrame:
    """Blocks of (id, term, w), or of lists (id, t, w) with one row an id, ids ascending in a block of a pool. With a
    column `group` (one number a row) the blocks hold that in place of the id. Blocks stay as they are."""
    if "block" in rows.columns:
        return rows
    if "t" in rows.columns:
        lists = rows.select(F.col("group" if "group" in rows.columns else "id").cast("long").alias("id"), "t", "w")
    else:
        group = F.max("group") if "group" in rows.columns else F.col("id")
        lists = rows.withColumn("t", F.xxhash64("term")).groupBy("id").agg(group.cast("long").alias("name"), F.collect_list("t").alias("t"), F.collect_list(F.col("w").cast("double")).alias("w"))
        lists = lists.select(F.col("name").alias("id"), "t", "w")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, block = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal held, n, block
            ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            terms, w = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            row = packed_row(block, ids, sizes, terms, w, index)
            held, n, block = [], 0, block + 1
            return row

        for batch in batches:
            ids, t, w = batch.column("id").to_numpy(), batch.column("t"), batch.column("w")
            ends = np.asarray(t.offsets)
            flat_t, flat_w, first = t.flatten().to_numpy(), w.flatten().to_numpy(), ends[0]
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + postings - n, side="right")) - 1)
                high = min(high, len(ids))
                a, b = ends[low] - first, ends[high] - first
                held.append((ids[low:high].copy(), np.diff(ends[low : high + 1]), flat_t[a:b].copy(), flat_w[a:b].copy()))
                n, low = n + int(b - a), high
                if n >= postings or low < len(ids):
                    yield out()
        if held:
            yield out()

    return lists.mapInArrow(cut, BLOCK)


def best_places(group: np.ndarray, sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: the larger similarity first, then the smaller id."""
    order = np.lexsort((ids, -sim, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[place < k]


def _products(sizes: np.ndarray, starts: np.ndarray, base: np.ndarray, w: np.ndarray, pool: _Pool) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of the products of postings with their terms' lists, those of equally long lists at once."""
    order = np.argsort(sizes.astype(np.uint16) if len(pool.ids) < 1 << 16 else sizes, kind="stable")
    sizes, starts, base, w = sizes[order], starts[order], base[order], w[order]
    total = int(sizes.sum())
    at, cells, values = pool.space(total)
    cut, out = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]) if total else np.zeros(0, np.int64), 0
    ends, groups = np.r_[cut[1:], len(sizes)], []
    steps = np.arange(int(sizes[-1]) if total else 0)
    for a, b in zip(cut.tolist(), ends.tolist()):
        size = int(sizes[a])
        np.add(starts[a:b, None], steps[:size], out=at[out : out + (b - a) * size].reshape(-1, size))
        groups.append((a, b, out, size))
        out += (b - a) * size
    np.take(pool.rows, at, out=cells, mode="clip")
    np.take(pool.w, at, out=values, mode="clip")
    for a, b, out, size in groups:
        part = slice(out, out + (b - a) * size)
        cells[part].reshape(-1, size)[...] += base[a:b, None]
        values[part].reshape(-1, size)[...] *= w[a:b, None]
    return cells, values


def _single(weights: np.ndarray) -> np.ndarray:
    return np.where(weights > 0, np.maximum(weights, _SMALL), 0).astype(np.float32)


class _Pool(_Block):
    """A block of a pool, ready to be met: common are its commonest terms, commonest first, and theirs their weights."""

    def __init__(self, row: dict | _Block, index: bool = True, low: float = 0.0):
        if isinstance(row, _Block):
            self.__dict__.update(row.__dict__)
        else:
            super().__init__(row, index)
            if not index:
                self.inverted()
        self.rows, self.start, self._space = self.at.astype(np.int64), np.cumsum(self.counts) - self.counts, []
        n = len(self.ids)
        common = np.flatnonzero(self.counts > 0.5 * DENSE**0.5 * n) if low <= 0 else np.flatnonzero(self.counts > 1)
        most = min(MOST_DENSE, DENSE_CELLS // max(n, 1)) if low <= 0 else 2 * DENSE_CELLS // max(n, 1)
        common = common[np.argsort(-self.counts[common], kind="stable")[:most]]
        self.common, self.theirs = common, np.zeros((n, len(common)))
        size = self.counts[common]
        at = np.arange(size.sum()) + np.repeat(self.start[common] - (np.cumsum(size) - size), size)
        self.theirs[self.at[at], np.repeat(np.arange(len(common)), size)] = self.w[at]
        if low > 0:
            # As many terms as leave most rows' lengths in them far from the threshold.
            while True:
                self.length = np.sqrt(np.einsum("ij,ij->i", self.theirs, self.theirs))
                if not len(self.common) or np.quantile(self.length, 0.95) ** 2 <= 0.7 * low:
                    break
                self.common = self.common[: len(self.common) // 2]
                self.theirs = np.ascontiguousarray(self.theirs[:, : len(self.common)])
        else:
            self.single = _single(self.theirs.T)

    def space(self, n: int) -> tuple[np.ndarray, ...]:
        """Arrays that are used again, as fresh ones cost more than what is done with them."""
        if not self._space or len(self._space[0]) < n:
            self._space = [np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n)]
        return tuple(x[:n] for x in self._space)


class _Best:
    """The k best of the rows of a block of a pool, as far as queries have met them."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.found, self.held = k, np.full(n, -1e-6), [], 0

    def look(self, most: np.ndarray) -> None:
        """Floors of rows that have none yet, from many queries' bounds."""
        fresh = np.flatnonzero(self.floor < 0)
        if len(fresh) and len(most) > self.k:
            at = len(most) - self.k
            self.floor[fresh] = np.maximum(self.floor[fresh], np.partition(most[:, fresh], at, axis=0)[at] * (1 - _OFF) - 2e-6)

    def add(self, rows: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        near = sim >= np.maximum(self.floor, 0)[rows]
        self.found.append((rows[near], ids[near], sim[near]))
        self.held += len(self.found[-1][0])
        if self.held > 2 * self.k * len(self.floor):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, ids, sim = (np.concatenate([f[x] for f in self.found] or [np.zeros(0)]) for x in range(3))
        rows, ids = rows.astype(np.int64), ids.astype(np.int64)
        best = best_places(rows, sim, ids, self.k)
        rows, ids, sim = rows[best], ids[best], sim[best]
        least = np.full(len(self.floor), np.inf)
        np.minimum.at(least, rows, sim)
        full = np.bincount(rows, minlength=len(self.floor)) >= self.k
        self.floor[full] = np.maximum(self.floor[full], least[full] - 2e-6)
        self.found, self.held = [(rows, ids, sim)], len(rows)
        return rows, ids, sim


class _Queries:
    """One block of queries (index: as one of a pool), and the k best of each as far as the pool's blocks were met."""

    def __init__(self, row: dict, k: int | None, low: float, index: bool = False):
        block = _Block(row, index)
        self.ids, self.keys, self.code, self.w, sizes = block.ids, block.keys, block.at, block.w, block.counts
        if index:
            order, self.code, _, sizes = _by_row(block)
            self.w = block.w[order]
        self.row, self.df = np.repeat(np.arange(len(self.ids), dtype=np.int32), sizes), np.bincount(self.code, minlength=len(self.keys))
        self.k, self.low, self.floor, self.found, self.held = k, low, np.full(len(self.ids), low), [], 0

    def meet(self, row: dict | _Block, same: str | None, by_group: bool = False, other: _Best | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query's number, pool id, similarity) of the pairs that may count, a bounded number of cells at a time.
        other: the pool's rows look for their best among the queries, too."""
        bounded = self.k is None and not by_group and self.low > 0
        pool = row if isinstance(row, _Pool) else _Pool(row, low=self.low if bounded else 0.0)
        ids, keys, n = pool.ids, pool.keys, len(pool.ids)
        if same == "less" and ids[-1] <= self.ids[0]:
            return
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        place = np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)
        known = keys[place] == self.keys
        size, start = np.where(known, pool.counts[place], 0), pool.start[place]
        # Terms of the matrix product, or (bounded) of the bound: their numbers among the pool's common ones.
        slot = np.full(len(keys), -1, np.int32)
        slot[pool.common] = np.arange(len(pool.common))
        slot = np.where(known, slot[place], -1)
        if not bounded:
            slot[size * self.df <= DENSE * n * len(self.ids)] = -1
        used = np.sort(slot[slot >= 0])
        met = np.bincount(self.row[(size > 0)[self.code]], minlength=len(self.ids)) > 0
        queries = np.flatnonzero(met)
        if not len(queries):
            return
        rare, column = ((size > 0) & (slot < 0))[self.code], slot[self.code]
        kept, shared = np.flatnonzero(rare), np.flatnonzero(column >= 0)
        q, sizes, starts, wq = self.row[kept], size[self.code[kept]], start[self.code[kept]], self.w[kept]
        qs, column, ws = self.row[shared], column[shared], self.w[shared]
        if bounded:
            length = np.sqrt(np.bincount(qs, ws * ws, minlength=len(self.ids)))
        elif not by_group:
            single = pool.single if len(used) == len(pool.common) else pool.single[used]
        # As many whole queries as keep products and cells in bounds.
        work = np.bincount(q, sizes, minlength=len(self.ids))[queries] + n + 2 * len(pool.common)
        part = (np.cumsum(work) - work) // CELLS
        local = np.cumsum(met) - 1
        for asked in np.split(queries, np.flatnonzero(np.diff(part)) + 1):
            a, b = np.searchsorted(q, (asked[0], asked[-1] + 1))
            cells, values = _products(sizes[a:b], starts[a:b], (local[q[a:b]] - local[asked[0]]) * n, wq[a:b], pool)
            sims = np.bincount(cells, values, minlength=len(asked) * n).astype(np.float64, copy=False).reshape(-1, n)
            a, b = np.searchsorted(qs, (asked[0], asked[-1] + 1))
            mine = np.zeros((len(asked), len(pool.common)))
            mine[local[qs[a:b]] - local[asked[0]], column[a:b]] = ws[a:b]
            most = sims
            if by_group:
                sims += mine @ pool.theirs.T
            elif bounded:
                most = np.multiply.outer(length[asked], pool.length)
                most += sims
            elif len(used):
                rest = _single(mine[:, used] if len(used) < len(pool.common) else mine) @ single
                sims += rest
            if same:
                own = np.searchsorted(ids, self.ids[asked], side="left" if same == "apart" else "right")
                if same == "apart":
                    i = np.flatnonzero((own < n) & (ids[np.minimum(own, n - 1)] == self.ids[asked]))
                    most[i, own[i]] = 0
                else:
                    most[np.arange(n)[None, :] < own[:, None]] = 0
            if by_group:
                most = np.maximum.reduceat(most, heads, axis=1)
            floor = self.floor[asked]
            if self.k is not None and n > 4 * self.k:
                fresh = np.flatnonzero(floor <= self.low)
                if len(fresh):
                    kth = np.partition(most[fresh], n - self.k, axis=1)[:, n - self.k]
                    floor[fresh] = np.maximum(floor[fresh], kth * (1 - _OFF) - 2e-6)
            least = np.maximum(floor * (1 - _OFF), 1e-310)[:, None]
            if other is not None:
                other.look(most)
                least = np.minimum(least, np.maximum(other.floor * (1 - _OFF), 1e-310))
            i, j = np.nonzero(most >= least)
            sim = most[i, j] if by_group else sims[i, j]
            if not by_group and len(used):
                if not bounded:
                    sim -= rest[i, j]
                for x in range(0, len(i), 1024):
                    some = slice(x, x + 1024)
                    sim[some] += np.einsum("ij,ij->i", mine[i[some]], pool.theirs[j[some]])
            if other is not None:
                other.add(j, self.ids[asked[i]], np.round(sim, PLACES))
            if not by_group:
                near = sim >= np.maximum(floor, 1e-310)[i]
                i, j, sim = i[near], j[near], sim[near]
            sim = np.round(sim, PLACES)
            if self.k is not None:
                best = best_places(i, sim, j, self.k)
                i, j, sim = i[best], j[best], sim[best]
                self._raise(asked[i], sim)
            yield asked[i], ids[heads[j]] if by_group else ids[j], sim

    def add(self, row: dict | _Block, same: str | None, by_group: bool = False) -> Iterator[pa.RecordBatch]:
        """Meet a block of the pool and hold the best; of more groups than HELD the largest so far leave."""
        for found in self.meet(row, same, by_group):
            self.found.append(found)
            self.held += len(found[0])
        if self.held > HELD:
            self._cut()
            if self.k is None and self.held > HELD // 2:
                yield from self.best()

    def _cut(self) -> None:
        if len(self.found) > 1:
            q, n, sim = (np.concatenate([f[x] for f in self.found]) for x in range(3))
            if self.k is None:
                order = np.lexsort((-sim, n, q))
                kept = order[np.r_[True, (np.diff(q[order]) != 0) | (np.diff(n[order]) != 0)]] if len(order) else order
            else:
                kept = best_places(q, sim, n, self.k)
            self.found, self.held = [(q[kept], n[kept], sim[kept])], len(kept)
        if self.k is not None and self.found:
            self._raise(self.found[0][0], self.found[0][2])

    def _raise(self, q: np.ndarray, sim: np.ndarray) -> None:
        """Floors of the queries that have k results here."""
        least = np.full(len(self.ids), np.inf)
        np.minimum.at(least, q, sim)
        full = np.bincount(q, minlength=len(self.ids)) >= self.k
        self.floor[full] = np.maximum(self.floor[full], least[full] - 2e-6)

    def best(self) -> Iterator[pa.RecordBatch]:
        self._cut()
        for q, n, sim in self.found:
            yield _pairs(self.ids[q], n, sim)
        self.found, self.held = [], 0


def _pairs(q: np.ndarray, n: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(sim)], ["q_id", "n_id", "sim"])


def written(rows: DataFrame, index: bool, postings: int = POSTINGS) -> DataFrame:
    """The blocks of rows as a table; blocks were written when they were made."""
    return rows if "block" in rows.columns else materialize(packed(rows, index, postings), "pool-blocks" if index else "query-blocks", BATCH)[0]


def merged(blocks: DataFrame, index: bool = True, postings: int | None = None) -> DataFrame:
    """A pool's blocks of `postings` or more, each made of several of the given ones (index: of a pool), written."""
    postings = postings or MERGED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full, number = [], 0, None

        def out() -> pa.RecordBatch:
            nonlocal held, full
            first = np.cumsum([0, *[len(h[0]) for h in held]])
            row = np.concatenate([h[3] + a for h, a in zip(held, first)])
            order = np.argsort(row, kind="stable")
            weighed = all(len(h[6]) for h in held)
            join = lambda i: np.concatenate([h[i] for h in held])
            ids, terms, w = join(0), join(2)[order], join(4)[order]
            own = (join(5)[order], join(6)) if weighed else (None, None)
            held, full = [], 0
            return packed_row(number, ids, np.bincount(row, minlength=len(ids)), terms, w, True, *own)

        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts, keys, at, w, idf, norm = (grown(batch.column(c)[i].as_buffer(), kind) for c, kind in zip(NAMES[1:], (np.int64, np.int32, np.int64, np.int32, np.float64, np.float64, np.float64)))
                key, row = (np.repeat(np.arange(len(keys)), counts), at) if index else (at, np.repeat(np.arange(len(ids)), counts))
                number = batch.column("block")[i].as_py() if not held else number
                held.append((ids, counts, keys[key], row, w, idf[key] if len(idf) else idf, norm))
                full += len(at)
                if full >= postings:
                    yield out()
        if held:
            yield out()

    return materialize(blocks.mapInArrow(run, BLOCK), "merged-blocks", BATCH)[0]


def _by_row(block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a pool's block row after row: their places, the numbers of their terms, and the rows' starts and lengths."""
    order, sizes = np.argsort(block.at, kind="stable"), np.bincount(block.at, minlength=len(block.ids))
    return order, np.repeat(np.arange(len(block.keys)), block.counts)[order], np.cumsum(sizes) - sizes, sizes


def in_groups(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """A pool's blocks with the numbers of groups (id, group) in the place of ids, written; a row stands once for each
    of its groups, and not at all without one. What is joined are ids, not vectors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block"), batch.column("ids")):
                ids = grown(data.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block.as_py())), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["block", "place", "id"])

    named = blocks.select("block", "ids").mapInArrow(rows, "block long, place int, id long").join(groups.select("id", F.col("group").cast("long").alias("group")), "id")
    held = named.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("group", "place"))).alias("h")).select("block", "h.group", "h.place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in NAMES[1:]}
                block, w, idf, norm = _Block(row, True), *(grown(row[c], np.float64) for c in NAMES[5:])
                order, key, starts, sizes = _by_row(block)
                place = batch.column("place")[i].values.to_numpy()
                s = sizes[place]
                take = np.arange(s.sum()) + np.repeat(starts[place] - (np.cumsum(s) - s), s)
                own = (idf[key[take]], norm[place]) if len(norm) else (None, None)
                yield packed_row(batch.column("block")[i].as_py(), batch.column("group")[i].values.to_numpy(), s, block.keys[key[take]], w[order[take]], True, *own)

    return materialize(blocks.join(held.hint("shuffle_hash"), "block").mapInArrow(run, BLOCK), "group-blocks", BATCH)[0]


def dots(pairs: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    """(q_id, n_id, sim) of given pairs (q_id, n_id), sim rounded, of rows that blocks of queries and of a pool hold.
    The pairs go to their query's block, and the pool is streamed past these, so no vector is shuffled for a pair."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block"), batch.column("ids")):
                ids = grown(data.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block.as_py())), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["block", "place", "q_id"])

    asked = q.select("block", "ids").mapInArrow(rows, "block long, place int, q_id long").join(pairs.select("q_id", "n_id"), "q_id")
    asked = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("n_id", "place"))).alias("h")).select("block", "h.n_id", "h.place")
    left, _ = materialize(q.join(asked.hint("shuffle_hash"), "block"), "asked-blocks", BATCH)
    parts = -(-TASKS * q.sparkSession.sparkContext.defaultParallelism // max(1, left.rdd.getNumPartitions()))
    both = p.select(*[F.col(c).alias(f"p_{c}") for c in NAMES]).coalesce(parts).crossJoin(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, pool = {}, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() if c.endswith("block") else batch.column(c)[i].as_buffer() for c in (*NAMES, *(f"p_{c}" for c in NAMES))}
                if row["p_block"] != number:
                    number, pool = row["p_block"], None
                    pool = _Block({c: row[f"p_{c}"] for c in NAMES}, True)
                    order, key, starts, sizes = _by_row(pool)
                if row["block"] not in held:
                    mine = _Block(row, False)
                    held[row["block"]] = mine, np.cumsum(mine.counts) - mine.counts, batch.column("n_id")[i].values.to_numpy(), batch.column("place")[i].values.to_numpy()
                mine, begin, wanted, place = held[row["block"]]
                at = np.minimum(np.searchsorted(pool.ids, wanted), len(pool.ids) - 1)
                here = np.flatnonzero(pool.ids[at] == wanted)
                if not len(here):
                    continue
                known = np.minimum(np.searchsorted(pool.keys, mine.keys), len(pool.keys) - 1)
                code = np.where(pool.keys[known] == mine.keys, known, -1)
                part = np.cumsum(mine.counts[place[here]] + sizes[at[here]]) // CELLS
                for some in np.split(here, np.flatnonzero(np.diff(part)) + 1):
                    a, b, n = place[some], at[some], np.arange(len(some))
                    x, y = mine.counts[a], sizes[b]
                    take = np.arange(x.sum()) + np.repeat(begin[a] - (np.cumsum(x) - x), x)
                    other = np.arange(y.sum()) + np.repeat(starts[b] - (np.cumsum(y) - y), y)
                    pair, t = np.repeat(n, x), code[mine.at[take]]
                    # A row's terms ascend in a pool's block.
                    theirs = np.repeat(n, y) * len(pool.keys) + key[other]
                    asked = pair * len(pool.keys) + t
                    met = np.minimum(np.searchsorted(theirs, asked), len(theirs) - 1)
                    hit = np.flatnonzero((t >= 0) & (theirs[met] == asked))
                    sim = np.bincount(pair[hit], mine.w[take[hit]] * pool.w[order[other[met[hit]]]], minlength=len(some)).astype(np.float64, copy=False)
                    yield _pairs(mine.ids[a], wanted[some], np.round(sim, PLACES))

    found = both.mapInArrow(run, "q_id long, n_id long, sim double")
    return materialize(found, "pair-dots", BATCH)[0]


def similar(q: DataFrame, p: DataFrame, k: int | None = None, low: float = 0.0, same: str | None = None, postings: int = POSTINGS, by_group: bool = False) -> DataFrame:
    """(q_id, n_id, sim), sim rounded: pairs that share a term and have sim >= low, with k those that may be among
    the k best of a query (the k best of each part of the pool). Weights must not be negative. same: "apart"
    leaves out a row with itself, "less" all but q_id < n_id. q and p may be one frame, which is then written once. If p has a column `group`, n_id is that and sim the
    largest of the group (of each part of the pool); by_group: p are blocks of in_groups()."""
    by_group = by_group or "group" in p.columns
    own = q is p
    right = written(p, True, postings)
    left = right if own else written(q, False, postings)
    # A task streams a part of the pool past a few blocks of queries, which it holds; parts are as few as cores allow.
    parts = -(-TASKS * q.sparkSession.sparkContext.defaultParallelism // max(1, left.rdd.getNumPartitions()))
    both = right.select(*[F.col(c).alias(f"p_{c}") for c in NAMES]).coalesce(parts).crossJoin(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hold, number, pool = {}, k is not None or by_group, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() if c.endswith("block") else memoryview(batch.column(c)[i].as_buffer()) for c in batch.schema.names}
                if row["p_block"] != number:
                    number, pool = row["p_block"], None
                    pool = _Pool({c: row[f"p_{c}"] for c in NAMES}, low=0.0 if hold else low - 1e-6)
                if row["block"] not in held:
                    if not hold:
                        held.clear()
                    held[row["block"]] = _Queries(row, k, low - 1e-6, own)
                if hold:
                    yield from held[row["block"]].add(pool, same, by_group)
                    continue
                mine = held[row["block"]]
                for a, b, sim in mine.meet(pool, same):
                    near = sim >= low
                    if near.any():
                        yield _pairs(mine.ids[a[near]], b[near], sim[near])
        for mine in held.values():
            yield from mine.best()

    return both.mapInArrow(run, "q_id long, n_id long, sim double")


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (least id of the component, id) that join what the given pairs join, one for each id but the least."""
    a, b = (np.concatenate([p[x] for p in pairs]) for x in range(2))
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        if (root[a] == root[b]).all():
            break
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[other]], ids[other]


def _met_once(blocks: DataFrame) -> DataFrame:
    """Every block of a pool with itself, and each two blocks once: either stands first in half of its pairs."""
    parts = -(-TASKS * blocks.sparkSession.sparkContext.defaultParallelism // max(1, blocks.rdd.getNumPartitions()))
    both = blocks.select(*[F.col(c).alias(f"p_{c}") for c in NAMES]).coalesce(parts).crossJoin(blocks)
    turn = F.pmod(F.xxhash64(F.least("block", "p_block"), F.greatest("block", "p_block")), F.lit(2)) == 0
    return both.where((F.col("block") == F.col("p_block")) | ((F.col("block") < F.col("p_block")) == turn))


def _near(batches: Iterator[pa.RecordBatch], low: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller id, larger id, similarity) of the pairs from `low` on of blocks that are _met_once()."""
    held, number, pool = {}, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() if c.endswith("block") else memoryview(batch.column(c)[i].as_buffer()) for c in batch.schema.names}
            if row["p_block"] != number:
                number, pool = row["p_block"], None
                pool = _Pool({c: row[f"p_{c}"] for c in NAMES}, low=low - 1e-6)
            if row["block"] not in held:
                held[row["block"]] = _Queries(row, None, low - 1e-6, True)
            mine = held[row["block"]]
            for a, b, sim in mine.meet(pool, "less" if row["block"] == number else None):
                near = sim >= low
                q, n = mine.ids[a[near]], b[near]
                yield np.minimum(q, n), np.maximum(q, n), sim[near]


def pairs_within(blocks: DataFrame, low: float) -> DataFrame:
    """(q_id, n_id, sim) of all pairs q_id < n_id of one set, as blocks of a pool, with a rounded similarity from `low`
    (above 0) on, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _near(batches, low):
            if len(found[0]):
                yield _pairs(*found)

    return materialize(_met_once(blocks).mapInArrow(run, "q_id long, n_id long, sim double"), "near-pairs", BATCH)[0]


def nearest_within(blocks: DataFrame, k: int) -> DataFrame:
    """(q_id, n_id, sim, rank) of the k nearest rows of each row of one set, as blocks of a pool, itself left out; written.

    Two blocks meet once, for the rows of both. A task puts out the best of a block of queries and of each block of the
    pool that it streams past these, packed; a block's packed results are then brought together, as no single rows are."""
    parts = "block long, ids binary, rows binary, near binary, sim binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, pool, theirs = {}, None, None, None

        def out(block: int, ids: np.ndarray, rows: np.ndarray, near: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
            data = shrunk(ids), shrunk(rows.astype(np.int32)), shrunk(near), shrunk(np.rint(sim * 10**PLACES).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x], pa.binary()) for x in data)], ["block", "ids", "rows", "near", "sim"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() if c.endswith("block") else memoryview(batch.column(c)[i].as_buffer()) for c in batch.schema.names}
                if row["p_block"] != number:
                    if theirs is not None and theirs.held:
                        yield out(number, pool.ids, *theirs.cut())
                    number, pool = row["p_block"], None
                    pool = _Pool({c: row[f"p_{c}"] for c in NAMES})
                    theirs = _Best(len(pool.ids), k)
                if row["block"] not in held:
                    held[row["block"]] = _Queries(row, k, -1e-6, True)
                mine, own = held[row["block"]], row["block"] == number
                for found in mine.meet(pool, "apart" if own else None, other=None if own else theirs):
                    mine.found.append(found)
                    mine.held += len(found[0])
                if mine.held > 2 * k * len(mine.ids):
                    mine._cut()
        if theirs is not None and theirs.held:
            yield out(number, pool.ids, *theirs.cut())
        for block, mine in held.items():
            mine._cut()
            for found in mine.found:
                yield out(block, mine.ids, *found)

    def best(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([grown(x.as_buffer(), kind) for x in table.column(c)])
        ids, rows, near, sim = grown(table.column("ids")[0].as_buffer(), np.int64), read("rows", np.int32), read("near", np.int64), read("sim", np.int64)
        kept = best_places(rows, sim, near, k)
        rows = rows[kept]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)])) + 1
        return pa.table({"q_id": ids[rows], "n_id": near[kept], "sim": sim[kept] / 10**PLACES, "rank": rank.astype(np.int32)})

    packed_best, path = materialize(_met_once(blocks).mapInArrow(run, parts), "block-best", BATCH)
    found, _ = materialize(packed_best.groupBy("block").applyInArrow(best, "q_id long, n_id long, sim double, rank int"), "topk-found", BATCH)
    drop_table(blocks.sparkSession, path)
    return found


def links(blocks: DataFrame, low: float, index: bool = False) -> DataFrame:
    """(q_id, n_id) that join the rows of one set (blocks of queries, or merged ones of a pool, index) as all pairs with
    a rounded similarity from `low` on would: a task puts out a pair for each row that it joins, not each pair that it found."""
    left = blocks if index else merged(blocks, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for q, p, _ in _near(batches, low):
            found.append((q, p))
            n += len(q)
            if n > HELD:
                found = [_joined(found)]
                n = len(found[0][0])
                if n > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], ["q_id", "n_id"])
                    found, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _joined(found)], ["q_id", "n_id"])

    return materialize(_met_once(left).mapInArrow(run, "q_id long, n_id long"), "links", BATCH)[0]
