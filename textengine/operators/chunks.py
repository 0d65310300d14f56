"""TF-IDF over chunks: many texts in one row with their distinct terms once.

What is shuffled is one small row for each term of a chunk, not one for each term of a text: the terms ask for their
idf, and a chunk weighs its texts when it has the idf of all its terms. Chunks are written once and hold about
POSTINGS pairs of text and term, about two bytes each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textengine.functions import text as X
from textengine.operators.blocks import BLOCK, grown, merged, packed_row, shrunk
from textengine.scratch import BATCH, drop_table, drop_written, materialize

#: Postings of a chunk.
POSTINGS = 1 << 19
#: Bytes of tokens that are counted at a time, and rows (id, term, w) that leave a task at a time.
BYTES, ROWS = 4 << 20, 1 << 16
_NAMES = ["chunk", "n", "ids", "sizes", "terms", "dfs", "at", "tf", "by"]


def _counted(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Terms per row, and by row and term the term's number and count; the terms."""
    sizes = np.diff(np.asarray(tokens.offsets)).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    most = max(len(coded.dictionary), 1)
    keys, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * most + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return np.bincount(keys // most, minlength=len(sizes)), (keys % most).astype(np.int32), tf.astype(np.int32), coded.dictionary


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BYTES of tokens and of one value of `by`."""
    for batch in batches:
        ends = np.asarray(batch.column("tokens").offsets).astype(np.int64)
        size = max(1, batch.column("tokens").flatten().nbytes // max(int(ends[-1] - ends[0]), 1))
        low, by = 0, batch.column("by").to_pylist()
        turns = [i for i in range(1, len(by)) if by[i] != by[i - 1]]
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + BYTES // size, side="right")) - 1)
            high = min([high, *turns[bisect_right(turns, low) :][:1]])
            yield batch.slice(low, high - low)
            low = high


def term_chunks(df: DataFrame, tokens: Column | None = None, postings: int = POSTINGS, by: Column | None = None) -> DataFrame:
    """Chunks of (id, text), written once. Texts of one id are one text (with `by` the least of theirs). by: a string;
    a chunk has one value of it, and blocks of different values share no term."""
    tokens = X.tokens(F.col("text")) if tokens is None else tokens
    rows = df.select("id", F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"), F.lit(1).cast("long").alias("n"), (F.lit(None) if by is None else by).cast("string").alias("by"))
    # Only ids that stand in several rows have to be brought together.
    again = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again"))
    again, _ = materialize(again, "repeated-ids")
    if not again.isEmpty():
        # A null id is an id like any other.
        same = F.col("id").eqNullSafe(F.col("again"))
        many = rows.join(again.hint("shuffle_hash"), same, "left_semi").groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.sum("n").alias("n"), F.min("by").alias("by"))
        rows = rows.join(again.hint("shuffle_hash"), same, "left_anti").unionByName(many)
    if by is not None:
        rows = rows.sortWithinPartitions("by")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("dfs", T.ArrayType(T.IntegerType())), T.StructField("at", T.BinaryType()), T.StructField("tf", T.BinaryType()), T.StructField("by", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, full, n, chunk, value = [], 0, 0, TaskContext.get().partitionId() << 32, None

        def out() -> pa.RecordBatch:
            nonlocal held, full, n, chunk
            words = pa.chunked_array([h[4] for h in held]).combine_chunks().dictionary_encode()
            place = words.indices.to_numpy(zero_copy_only=False)
            first = np.cumsum([0, *[len(h[4]) for h in held]])
            at = np.concatenate([place[a : a + len(h[4])][h[2]] for a, h in zip(first, held)]).astype(np.int32)
            dfs = np.bincount(at, minlength=len(words.dictionary)).astype(np.int32)
            ids, sizes, tf = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[3] for h in held])
            order = np.lexsort((at, np.repeat(np.arange(len(sizes)), sizes)))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids, words.dictionary, pa.array(dfs))]
            row = [pa.array([chunk]), pa.array([n], pa.int64()), lists[0], pa.array([shrunk(sizes.astype(np.int32))]), lists[1], lists[2], pa.array([shrunk(at[order])]), pa.array([shrunk(tf[order])]), pa.array([value], pa.string())]
            held, full, n, chunk = [], 0, 0, chunk + 1
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays(row, _NAMES)

        for batch in _pieces(batches):
            if (new := batch.column("by")[0].as_py()) != value:
                if held:
                    yield out()
                value = new
            n += pc.sum(batch.column("n")).as_py()
            sizes, at, tf, terms = _counted(batch.column("tokens"))
            kept = np.flatnonzero(sizes)
            ids, sizes = batch.column("id").take(pa.array(kept)), sizes[kept]
            ends = np.r_[0, np.cumsum(sizes)]
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + postings - full, side="right")) - 1)
                a, b = ends[low], ends[high]
                used, code = np.unique(at[a:b], return_inverse=True)
                held.append((ids.slice(low, high - low), sizes[low:high], code, tf[a:b], terms.take(pa.array(used))))
                full, low = full + int(b - a), high
                if full >= postings or low < len(ids):
                    yield out()
        if held:
            yield out()
        elif n:
            empty = pa.array([shrunk(np.zeros(0, np.int32))])
            none = [pa.array([[]], pa.list_(t)) for t in (batch.schema.field("id").type, pa.string(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([n], pa.int64()), none[0], empty, none[1], none[2], empty, empty, pa.array([value], pa.string())], _NAMES)

    return materialize(rows.mapInArrow(cut, schema), "term-chunks", BATCH)[0]


def _terms(chunks: DataFrame) -> DataFrame:
    """(chunk, at, term, n): the terms of a chunk, their numbers in it and how many of its texts hold them."""
    return chunks.select("chunk", F.posexplode(F.arrays_zip("terms", "dfs")).alias("at", "t")).select("chunk", "at", F.col("t.terms").alias("term"), F.col("t.dfs").cast("long").alias("n"))


def known_terms(chunks: DataFrame, fit: DataFrame, min_df: int = 2) -> DataFrame:
    """(chunk, places, idfs): the terms of a chunk that min_df texts of the chunks `fit` hold, with idf ln((1 + N) / (1 + df)) + 1."""
    mine = _terms(chunks)
    if fit is not chunks:
        nothing = _terms(fit).select(F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("at"), "term", "n")
        mine = mine.withColumn("n", F.lit(0).cast("long")).unionByName(nothing)
    where = F.when(F.col("chunk").isNotNull(), F.struct("chunk", "at"))
    terms = mine.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(where).alias("held")).where((F.col("df") >= min_df) & (F.size("held") > 0))
    idf = F.log((1 + F.col("all")) / (1 + F.col("df"))) + 1
    rows = terms.crossJoin(F.broadcast(fit.agg(F.sum("n").alias("all")))).select(idf.alias("idf"), F.explode("held").alias("h"))
    return rows.groupBy(F.col("h.chunk").alias("chunk")).agg(F.collect_list("h.at").alias("places"), F.collect_list("idf").alias("idfs"))


def weights(chunks: DataFrame, fit: DataFrame, min_df: int = 2, sublinear: bool = True, binary: bool = False, form: str = "rows", kept: Column | None = None) -> DataFrame:
    """(id, term, w): tf times idf with L2-normalized rows; terms that the fit lacks go. Other forms have terms as
    hashes of 64 bits: "lists" (id, t, w) with a row a text, and the blocks of a search, of "queries" or of a "pool", which are written. kept: a condition on the chunks that are wanted."""
    known = known_terms(chunks, fit, min_df)
    if kept is not None:
        chunks = chunks.where(kept)
    if form != "rows":
        chunks = chunks.withColumn("terms", F.transform("terms", lambda t: F.when(F.col("by").isNull(), F.xxhash64(t)).otherwise(F.xxhash64(t, F.col("by")))))
    rows = chunks.drop("n", "dfs", "by").join(known.hint("shuffle_hash"), "chunk")
    kind = chunks.schema["ids"].dataType.elementType
    fields = [("t", T.ArrayType(T.LongType())), ("w", T.ArrayType(T.DoubleType()))] if form == "lists" else [("term", T.StringType()), ("w", T.DoubleType())]
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, t) for n, t in fields]])
    if form in ("queries", "pool"):
        schema = BLOCK

    def one(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        read = lambda name: grown(batch.column(name)[i].as_buffer(), np.int32)
        items = lambda name: batch.column(name)[i].values
        ids, terms, sizes, at, tf = items("ids"), items("terms"), read("sizes"), read("at"), read("tf")
        idf = np.zeros(len(terms))
        idf[items("places").to_numpy()] = items("idfs").to_numpy()
        held = np.zeros(len(terms), bool)
        held[items("places").to_numpy()] = True
        kept = np.flatnonzero(held[at])
        row, at, tf = np.repeat(np.arange(len(ids)), sizes)[kept], at[kept], tf[kept]
        count = np.ones(len(tf)) if binary else 1 + np.log(tf) if sublinear else tf.astype(np.float64)
        w = count * idf[at]
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(ids)))
        w = w / norm[row]
        if form == "rows":
            for a in range(0, len(row), ROWS):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[a : a + ROWS])), terms.take(pa.array(at[a : a + ROWS])), pa.array(w[a : a + ROWS])], ["id", "term", "w"])
            return
        hashes, ends = terms.to_numpy()[at], np.r_[0, np.cumsum(np.bincount(row, minlength=len(ids)))]
        some = np.flatnonzero(np.diff(ends))
        if form != "lists":
            if len(some):
                yield packed_row(batch.column("chunk")[i].as_py(), ids.take(pa.array(some)).to_numpy().astype(np.int64), np.diff(ends)[some], hashes, count, form == "pool", idf[at], norm[some])
            return
        part = ends[some] // ROWS
        for rows in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else []:
            a, b = ends[rows[0]], ends[rows[-1] + 1]
            offsets = pa.array(np.r_[ends[rows] - a, b - a].astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(hashes[a:b])), pa.ListArray.from_arrays(offsets, pa.array(w[a:b]))], ["id", "t", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from one(batch, i)
            pa.default_memory_pool().release_unused()

    found = rows.mapInArrow(run, schema)
    if schema != BLOCK:
        return found
    blocks, path = materialize(found, f"{form}-blocks", BATCH)
    if form == "pool":
        small, small_path = blocks, path
        blocks = merged(small)
        drop_table(small.sparkSession, small_path)
    return blocks


def own_blocks(chunks: DataFrame, kept: Column | None = None) -> DataFrame:
    """The blocks of a set that is searched by itself; the chunks go when they are written."""
    blocks = weights(chunks, chunks, form="pool", kept=kept)
    drop_written(chunks)
    return blocks


def search_sides(q: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of a search for the chunks q among the chunks p, fitted on these; the chunks go when the blocks are written."""
    blocks = weights(q, p, form="queries"), weights(p, p, form="pool")
    for chunks in {id(x): x for x in (q, p)}.values():
        drop_written(chunks)
    return blocks
