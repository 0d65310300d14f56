"""Operator 4: MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles. Equal sets form a class, and only one
document per class goes on. Its signature has `chunks` x `width` minima of 32 bits; the distance of two
signatures is the number of positions that differ. If at most `errors` = chunks * (allowed + 1) - 1
positions differ, then by pigeonhole some chunk differs in `allowed` positions at most: every
chunk is indexed once for each choice of `allowed` positions left out, and all pairs within the distance
meet under some key. (Two sets of similarity 0.8 also meet beyond that distance: a chunk of six
agrees in five with probability 0.655, and one of ten chunks does with 0.99998.)

All pairs that meet are settled without listing them. Each key links its members to its least member
after the full sets confirm it; documents that are then in different components though they share a key
are compared exactly in blocks, with the intersections counted through an inverted index.
No bucket is cut or capped, only blocks are bounded.

A text without words, or null, is an empty set, linked with nothing. A row without id is its own
document: component null, kept. Repeated rows fall into one class. Ids must tell texts apart, else the
row that is read first stands for its id. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced
from .components import components

CHUNKS, WIDTH, ALLOWED = 10, 6, 1
ERRORS = CHUNKS * (ALLOWED + 1) - 1
#: Linked sets of similarity 0.8 differ in 12 of 60 positions on average, with a standard
#: deviation of 3.1; beyond 34 (seven deviations) a pair that met is not read in full.
FAR = 34
#: Rows of a block, and hashes of its sets.
BLOCK_ROWS, BLOCK_HASHES = 1500, 4_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


class Shingler:
    """Sets of distinct 2-word shingles as sorted 64-bit hashes."""

    def __init__(self) -> None:
        self.of: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        of = self.of
        if len(of) > 1_000_000:
            of.clear()
        for w in set(words).difference(of):
            of[w] = xxhash.xxh64_intdigest(w)
        codes = np.fromiter((of[w] for w in words), np.uint64, len(words))
        if len(codes) > 1:
            codes = _mix(codes[:-1] * _A + _mix(codes[1:]))
        elif len(codes):
            codes = _mix(codes + np.uint64(1))
        return np.unique(codes)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = (a[:, None] * shingles[None, at : at + 4096] + b[:, None]) >> np.uint64(32)
        least = np.minimum(least, part.min(1).astype(np.uint32))
    return least


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n (size of its set), hi and lo (128 bits that tell sets apart), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (a, b) = Shingler(), _permutations(CHUNKS * WIDTH)
        for batch in sliced(batches, "text"):
            n, hi, lo, sig = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t)
                both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                n.append(len(s))
                hi.append(int(both[0]))
                lo.append(int(both[1]))
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "hi", "lo", "sig"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, hi long, lo long, sig binary")


def sets(df: DataFrame) -> DataFrame:
    """(id, n, hashes): the full sets of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in sliced(batches, "text"):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "n", "hashes"])

    return df.select("id", "text").mapInArrow(run, "id long, n long, hashes binary")


def keys(reps: DataFrame) -> DataFrame:
    """(key, rep, n): every chunk of a signature, without each choice of ALLOWED positions."""
    rests = [[p for p in range(WIDTH) if p not in out] for out in itertools.combinations(range(WIDTH), ALLOWED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
                found = []
                for c in range(CHUNKS):
                    for r, rest in enumerate(rests):
                        code = np.full(batch.num_rows, c * len(rests) + r + 1, np.uint64) * _A
                        for p in rest:
                            code = _mix(code + sig[:, c * WIDTH + p]) * _A
                        found.append(_mix(code))
                many = len(found)
                rep, n = (np.tile(batch.column(c).to_numpy(zero_copy_only=False), many) for c in ("rep", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(rep), pa.array(n)], names=["key", "rep", "n"])

    return reps.select("rep", "n", "sig").mapInArrow(run, "key long, rep long, n long")


def _alike(a, b, percent: int):
    """Sizes that similarity allows."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = full.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    right = full.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


class _Forest:
    """Components of a block's rows; link() joins a row with others and notes the links that mattered."""

    def __init__(self, label: np.ndarray, rep: np.ndarray):
        self.at, self.rep, self.links = np.unique(label, return_inverse=True)[1], rep, []

    def link(self, k: int, others: np.ndarray) -> None:
        at = self.at
        others = others[at[others] != at[k]]
        while len(others):
            self.links.append((self.rep[k], self.rep[others[0]]))
            at[at == at[others[0]]] = at[k]
            others = others[at[others] != at[k]]

    def table(self) -> pd.DataFrame:
        return pd.DataFrame(self.links, columns=["a", "b"], dtype="int64")


def _in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows once for each pair of blocks (i, j) of their group that they belong to."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col(blocks)))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))).select(
        "*", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )


def _near_signatures(part: pd.DataFrame) -> pd.DataFrame:
    """Of one pair of blocks of a bucket: a spanning forest of what may be linked beyond the
    components so far (label), judged by signatures and sizes."""
    sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), -1)
    label, n = part["label"].to_numpy(), part["n"].to_numpy()
    forest = _Forest(label, part["rep"].to_numpy())
    # Whoever is in the largest component is compared with all others, from the others' side.
    values, counts = np.unique(label, return_counts=True)
    for k in np.flatnonzero(label != values[counts.argmax()]):
        apart = np.flatnonzero((forest.at != forest.at[k]) & (100 * np.minimum(n, n[k]) >= 80 * np.maximum(n, n[k])))
        forest.link(k, apart[(sig[apart] != sig[k]).sum(1) <= FAR])
    return forest.table()


def _exact_links(percent: int):
    def links(part: pd.DataFrame) -> pd.DataFrame:
        """Of one pair of blocks of a cluster: exact links between components (label), as a
        spanning forest. Intersections are counted through an inverted index."""
        found = [np.frombuffer(h, np.uint64) for h in part["hashes"]]
        label = part["label"].to_numpy()
        sizes = np.array([len(s) for s in found], np.int64)
        forest = _Forest(label, part["rep"].to_numpy())
        _, code = np.unique(np.concatenate(found), return_inverse=True)
        owner = np.repeat(np.arange(len(found)), sizes)
        order = np.argsort(code, kind="stable")
        holders, starts = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
        ends = np.cumsum(sizes)
        values, counts = np.unique(label, return_counts=True)
        for k in np.flatnonzero(label != values[counts.argmax()]):
            mine = code[ends[k] - sizes[k] : ends[k]]
            lists = [holders[starts[c] : starts[c + 1]] for c in mine if starts[c + 1] - starts[c] > 1]
            if not lists:
                continue
            both = np.bincount(np.concatenate(lists), minlength=len(found))
            forest.link(k, np.flatnonzero(100 * both >= percent * (sizes + sizes[k] - both)))
        return forest.table()

    return links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id and kept. percent is 80 or more: the
    signatures are made for such similarities."""
    if percent < 80:
        raise ValueError("similarities below 0.8 need other signatures")
    docs, _ = materialize(signatures(df, key, text), "dup-signatures")
    classes, _ = materialize(
        docs.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "dup-classes"
    )
    index = keys(classes)
    buckets = index.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("hub")).where(F.col("size") > 1)
    members, _ = materialize(index.join(buckets, "key").select("key", "rep", "n", "size", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "dup-members")
    pairs = members.where((F.col("rep") != F.col("hub")) & _alike(F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    chosen = members.select(F.col("rep").alias("id")).distinct()
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(chosen.hint("shuffle_hash"), "id", "left_semi")
    full, _ = materialize(sets(texts).where(F.col("n") > 0).dropDuplicates(["id"]), "dup-sets")
    links, _ = materialize(confirm(pairs, full, percent), "dup-links")
    found, _ = materialize(components(links), "dup-components")

    # Buckets of three or more whose members are still in different components; of buckets
    # with the same members one will do.
    labelled = members.where(F.col("size") > 2).join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.first("size").alias("size"))
        .where(F.col("least") != F.col("most"))
        .groupBy("who", "size")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    open_rows = labelled.join(open_keys, "key").join(classes.select("rep", "sig"), "rep").select("key", "rep", "n", "label", "sig", F.ceil(F.col("size") / BLOCK_ROWS).cast("long").alias("blocks"))
    maybe = _in_blocks(open_rows, "blocks").repartition("key", "i", "j").groupBy("key", "i", "j").applyInPandas(_near_signatures, "a long, b long")
    maybe, _ = materialize(maybe.distinct(), "dup-maybe")
    if not maybe.isEmpty():
        # Components that may touch form clusters; all members of a cluster are compared exactly.
        label = found.select(F.col("node").alias("id"), "component")

        def labels(of: DataFrame, column: str) -> DataFrame:
            return of.join(label.withColumnRenamed("id", column), column, "left").withColumn(column, F.coalesce("component", column)).drop("component")

        touching = labels(labels(maybe, "a"), "b").where(F.col("a") != F.col("b"))
        clusters, _ = materialize(components(touching), "dup-clusters")
        inside = full.withColumnRenamed("id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        inside = inside.join(clusters.select(F.col("node").alias("label"), F.col("component").alias("cluster")), "label")
        blocks = inside.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_HASHES)).cast("long").alias("blocks"))
        grouped = _in_blocks(inside.join(blocks, "cluster"), "blocks").select("cluster", "i", "j", "rep", "label", "hashes").repartition("cluster", "i", "j")
        more = grouped.groupBy("cluster", "i", "j").applyInPandas(_exact_links(percent), "a long, b long")
        links, _ = materialize(links.union(more), "dup-all-links")
        found, _ = materialize(components(links), "dup-all-components")
    of_class = classes.select("hi", "lo", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.coalesce("component", "rep").alias("component"))
    named = docs.select("id", "n", "hi", "lo").join(of_class, (F.col("n") > 0) & (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
