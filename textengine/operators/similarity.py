"""Similarity joins and nearest neighbours (JN) on long tables.

Sparse vectors are rows (id, term, w); searches and joins compare them block against block of
packed vectors (blocks), so no row stands for a pair of rows and a term. Dense vectors are
compared block against block in matrix products; blocks have a bounded number of rows.
Similarities are rounded to 6 places before ranking, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.functions import text as X
from textengine.operators.blocks import TASKS, best_places, block_ids, dots, in_groups, nearest_within, pairs_within, similar, written
from textengine.scratch import BATCH, drop_table, materialize

PLACES = 6


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """Add rank (1 is best) to (q_id, n_id, sim) and keep the k best per query."""
    rows = pairs.withColumn("sim", F.round("sim", PLACES))
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("sim"), "n_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def sparse_pairs(q: DataFrame, p: DataFrame) -> DataFrame:
    """(q_id, n_id, sim) of all pairs that share a term."""
    a = q.select(F.col("id").alias("q_id"), "term", F.col("w").alias("wq"))
    b = p.select(F.col("id").alias("n_id"), "term", F.col("w").alias("wp"))
    return a.join(b, "term").groupBy("q_id", "n_id").agg(F.sum(F.col("wq") * F.col("wp")).alias("sim"))


#: Similarities are rounded, so what lies less than this below a bound may still tie with it.
_TIE = 2e-6
#: Share of a query's postings that must be left out to be worth looking its pairs up again.
SAVED = 0.75


def bounded_marks(q: DataFrame, p: DataFrame, k: int, same: bool = False, unit: bool = True) -> DataFrame:
    """The query terms that the pool has, with what each has to be read for.

    Postings are ordered by impact. The first 2 k of every term give sums that no similarity is
    below, and so a k-th best (`floor`) for each query. From the commonest term on, terms can be left out of the
    search while all of them together can't lift a row to the floor: sums of weight times the term's largest
    weight bound them and, unit (rows of length 1), the length of the query's part does, too. Of the first term beyond those
    (`edge`), postings below `need` can't lift a row there either; it is read whole if `need` is less than half
    the term's largest weight, as its sums are then worth more than what is saved. A query for which that leaves out less
    than SAVED of its postings reads all of them, as its pairs then need no second look. Columns: q_id, term, wq, part
    (left, edge, core), need, upto and below (bounds with and without the term), floor.
    """
    a = q.select(F.col("id").alias("q_id"), "term", F.col("w").alias("wq"))
    b = p.select(F.col("id").alias("n_id"), "term", F.col("w").alias("wp"))
    asked = a.join(b.groupBy("term").agg(F.count("*").alias("df"), F.max("wp").alias("most")), "term")
    heads = b.withColumn("place", F.row_number().over(W.partitionBy("term").orderBy(F.desc("wp"), "n_id"))).where(F.col("place") <= 2 * k)
    sums = _apart(asked.join(heads, "term"), same).groupBy("q_id", "n_id").agg(F.sum(F.col("wq") * F.col("wp")).alias("sum"))
    best = sums.withColumn("place", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("sum")))).where(F.col("place") <= k)
    floors = best.where(F.col("place") == k).select("q_id", F.col("sum").alias("floor"))
    rows = asked.join(floors, "q_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - _TIE)
    order = W.partitionBy("q_id").orderBy(F.desc("df"), "term").rowsBetween(W.unboundedPreceding, 0)
    impact, square = F.col("wq") * F.col("most"), F.col("wq") * F.col("wq")

    def bound(without: bool) -> Column:
        by_impact = F.sum(impact).over(order) - (impact if without else 0)
        by_length = F.sqrt(F.greatest(F.sum(square).over(order) - (square if without else 0), F.lit(0.0)))
        return F.least(by_impact, by_length) if unit else by_impact

    rows = rows.withColumns({"upto": bound(False), "below": bound(True)})
    rows = rows.withColumn("need", (F.col("floor") - F.col("below")) / F.col("wq"))
    edge = (F.col("below") < F.col("floor")) & (F.col("need") * 2 >= F.col("most"))
    rows = rows.withColumn("part", F.when(F.col("upto") < F.col("floor"), "left").when(edge, "edge").otherwise("core"))
    one = W.partitionBy("q_id")
    spared = F.sum(F.when(F.col("part") != "core", F.col("df")).otherwise(0)).over(one) >= SAVED * F.sum("df").over(one)
    return rows.select("q_id", "term", "wq", F.when(spared, F.col("part")).otherwise("core").alias("part"), "need", "upto", "below", "floor")


def _apart(pairs: DataFrame, same: bool) -> DataFrame:
    return pairs.where(F.col("q_id") != F.col("n_id")) if same else pairs


def bounded_pairs(marks: DataFrame, p: DataFrame, same: bool = False) -> DataFrame:
    """(q_id, n_id, sum, edge): all pairs that may reach the floor, with the sum over what was read;
    edge: whether that holds the edge term."""
    b = p.select(F.col("id").alias("n_id"), "term", F.col("w").alias("wp"))
    met = marks.where(F.col("part") != "left").join(b, "term").where((F.col("part") == "core") | (F.col("wp") >= F.col("need")))
    return _apart(met, same).groupBy("q_id", "n_id").agg(F.sum(F.col("wq") * F.col("wp")).alias("sum"), F.max(F.col("part") == "edge").alias("edge"))


def bounded_topk(q: DataFrame, p: DataFrame, k: int, same: bool = False, unit: bool = True) -> DataFrame:
    """The k most similar pool rows of each query, exactly, without a join on common terms.

    Rare terms find the pairs; the terms that were left out are looked up only for pairs that may still be among the
    k best. Weights must not be negative; unit: rows have length 1 at most. Both sides are written once, as
    they are read several times.
    """
    p, pool_path = materialize(p.select("id", "term", "w"), "topk-pool")
    q, query_path = (p, None) if same else materialize(q.select("id", "term", "w"), "topk-queries")
    marks, marks_path = materialize(bounded_marks(q, p, k, same, unit), "topk-marks")
    by_query = marks.groupBy("q_id").agg(
        F.max("floor").alias("floor"),
        F.coalesce(F.max(F.when(F.col("part") == "left", F.col("upto"))), F.lit(0.0)).alias("left_out"),
        F.coalesce(F.max(F.when(F.col("part") == "edge", F.col("need") * F.col("wq"))), F.lit(0.0)).alias("edge_out"),
    )
    # The terms left out and the edge are bounded apart, as most pairs hold the edge term.
    pairs = bounded_pairs(marks, p, same)
    place = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("sum")))
    kth = F.max(F.when(F.col("place") == k, F.col("sum"))).over(W.partitionBy("q_id"))
    rows = pairs.withColumn("place", place).withColumn("kth", kth).join(by_query, "q_id")
    reach = F.col("sum") + F.col("left_out") + F.when(F.col("edge"), 0.0).otherwise(F.col("edge_out"))
    open_pairs, open_path = materialize(rows.where(reach >= F.greatest("floor", F.coalesce("kth", F.lit(0.0)) - _TIE)).select("q_id", "n_id", "sum", "edge"), "topk-open")
    rest = marks.where(F.col("part") != "core").select("q_id", "term", "wq", "part")
    b = p.select(F.col("id").alias("n_id"), "term", F.col("w").alias("wp"))
    asked = open_pairs.select("q_id", "n_id", "edge").join(rest, "q_id").where((F.col("part") == "left") | ~F.col("edge"))
    more = asked.join(b, ["n_id", "term"]).groupBy("q_id", "n_id").agg(F.sum(F.col("wq") * F.col("wp")).alias("more"))
    sims = open_pairs.join(more, ["q_id", "n_id"], "left").select("q_id", "n_id", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sim"))
    found, _ = materialize(top_k(sims, k), "topk-found")
    for path in (pool_path, query_path, marks_path, open_path):
        if path:
            drop_table(p.sparkSession, path)
    return found


def sparse_topk(q: DataFrame, p: DataFrame, k: int, same: bool = False) -> DataFrame:
    """The k most similar pool rows of each query, exactly, block by block; ids are integers."""
    if same and q is p:
        return nearest_within(written(p, True), k)
    found, _ = materialize(top_k(similar(q, p, k, same="apart" if same else None), k), "topk-found", BATCH)
    return found


def loo_topk(rows: DataFrame, k: int) -> DataFrame:
    """Neighbours within one set, without oneself."""
    return sparse_topk(rows, rows, k, same=True)


def class_sides(q: DataFrame, p: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a search inside each class: a query stands once for each class that has one of its terms, and
    a term once for each class that holds it. labels (id, class), one class a row; rows without one are left out."""
    of_class = p.join(labels.select("id", "class").where(F.col("class").isNotNull()), "id")
    held = of_class.select("class", "term").distinct()
    asked = q.select("id", "term", "w").join(held, "term")
    term = F.struct("class", "term").alias("term")
    return asked.select(F.struct(F.col("id").alias("q"), "class").alias("id"), term, "w"), of_class.select("id", term, "w")


def best_per_class(q: DataFrame, p: DataFrame, labels: DataFrame) -> DataFrame:
    """(q_id, class, best): similarity of the nearest row of every class that shares a term with the query.

    The pool's rows stand under their class's number, so that its blocks give one value for each class.
    """
    known = labels.select("id", "class").where(F.col("class").isNotNull())
    numbers = known.select("class").distinct().withColumn("group", F.row_number().over(W.orderBy("class")))  # a small dimension
    numbers, path = materialize(numbers, "class-numbers")
    groups = known.join(F.broadcast(numbers), "class").select("id", "group")
    pool = in_groups(p, groups) if "block" in p.columns else p.join(groups, "id")
    found = similar(q, pool, by_group=True).groupBy("q_id", F.col("n_id").alias("group")).agg(F.max("sim").alias("best"))
    found, _ = materialize(found.join(F.broadcast(numbers), "group").select("q_id", "class", "best"), "class-best", BATCH)
    drop_table(p.sparkSession, path)
    return found


#: Queries that are compared with a block of dense vectors at a time.
DENSE_ROWS = 256
_DENSE = "block long, ids binary, groups binary, vecs binary"


def _dense_blocks(df: DataFrame, group: Column, rows_per_block: int) -> DataFrame:
    """Blocks of (id, vec): ids in order, their groups and unit vectors, written."""
    n = max(1, -(-11 * df.count() // (10 * rows_per_block)))
    rows = df.select(F.col("id").cast("long").alias("id"), group.cast("long").alias("g"), F.col("vec").cast("array<double>").alias("vec")).repartition(n, "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, full, block = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal held, full, block
            ids, g, m = (np.concatenate([h[x] for h in held]) for x in range(3))
            order, size = np.argsort(ids, kind="stable"), np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
            row = [pa.array([block]), *(pa.array([x[order].tobytes()], pa.binary()) for x in (ids, g, m))]
            held, full, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "groups", "vecs"])

        for batch in batches:
            for low in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(low, rows_per_block)
                held.append((part.column("id").to_numpy(), part.column("g").to_numpy(), part.column("vec").flatten().to_numpy().reshape(part.num_rows, -1)))
                full += part.num_rows
                if full >= rows_per_block:
                    yield out()
        if held:
            yield out()

    return materialize(rows.mapInArrow(pack, _DENSE), "dense-blocks", BATCH)[0]


def dense_topk(q: DataFrame, p: DataFrame, k: int, same: bool = False, apart: Column | None = None, rows_per_block: int = 4000) -> DataFrame:
    """Exact cosine top-k of (id, vec) rows: each query block meets each pool block once. Rows of
    one group `apart` (an integer expression of id, such as a fold) are no neighbours; same: nor is a row its own.

    Both sides are packed into blocks once, and a task streams a part of the pool past a few blocks of queries, of which
    it holds the best: neither vectors nor results are copied for each pair of blocks."""
    group = apart if apart is not None else F.col("id") if same else None
    left = _dense_blocks(q, group if group is not None else F.lit(0), rows_per_block)
    right = left if q is p and group is not None else _dense_blocks(p, group if group is not None else F.lit(1), rows_per_block)
    parts = -(-TASKS * q.sparkSession.sparkContext.defaultParallelism // max(1, left.rdd.getNumPartitions()))
    both = right.select(*[F.col(c).alias(f"p_{c}") for c in left.columns]).coalesce(parts).crossJoin(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, pool = {}, None, None

        def read(batch: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            get = lambda c, kind: np.frombuffer(batch.column(side + c)[i].as_py(), kind)
            ids = get("ids", np.int64)
            return ids, get("groups", np.int64), get("vecs", np.float64).reshape(len(ids), -1)

        def cut(found: list) -> None:
            rows, n, sim = (np.concatenate([f[x] for f in found]) for x in range(3))
            best = best_places(rows, sim, n, k)
            found[:] = [(rows[best], n[best], sim[best])]

        for batch in batches:
            for i in range(batch.num_rows):
                if (new := batch.column("p_block")[i].as_py()) != number:
                    number, pool = new, read(batch, i, "p_")
                if (mine := batch.column("block")[i].as_py()) not in held:
                    ids, groups, vecs = read(batch, i, "")
                    held[mine] = ids, groups, vecs, np.full(len(ids), -np.inf), []
                ids, groups, vecs, floor, found = held[mine]
                for low in range(0, len(ids), DENSE_ROWS):
                    some = slice(low, low + DENSE_ROWS)
                    sims = vecs[some] @ pool[2].T
                    sims[groups[some, None] == pool[1]] = -np.inf
                    fresh = np.flatnonzero(np.isneginf(floor[some]))
                    least = floor[some].copy()
                    if len(fresh) and len(pool[0]) > k:
                        least[fresh] = np.partition(sims[fresh], len(pool[0]) - k, axis=1)[:, len(pool[0]) - k] - 2 * 10.0**-PLACES
                    row, at = np.nonzero(sims >= np.maximum(least, -2.0)[:, None])
                    sim = np.round(sims[row, at], PLACES)
                    best = best_places(row, sim, pool[0][at], k)
                    found.append((low + row[best], pool[0][at[best]], sim[best]))
                cut(found)
                n = np.bincount(found[0][0], minlength=len(ids))
                worst = np.full(len(ids), np.inf)
                np.minimum.at(worst, found[0][0], found[0][2])
                floor[n >= k] = worst[n >= k] - 2 * 10.0**-PLACES
        for ids, _, _, _, found in held.values():
            for rows, n, sim in found:
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(n), pa.array(sim)], ["q_id", "n_id", "sim"])

    return top_k(both.mapInArrow(run, "q_id long, n_id long, sim double"), k)


def _ids(rows: DataFrame) -> DataFrame:
    return (block_ids(rows) if "block" in rows.columns else rows.select("id")).distinct()


def max_sim(q: DataFrame, p: DataFrame) -> DataFrame:
    """(id, sim, n_id) of the nearest row of a set; sim 0 where nothing is shared."""
    near = sparse_topk(q, p, 1).select(F.col("q_id").alias("id"), "sim", "n_id")
    return _ids(q).join(near, "id", "left").select("id", F.coalesce("sim", F.lit(0.0)).alias("sim"), "n_id")


def sim_join(a: DataFrame, b: DataFrame, low: float, high: float = 1.01, same: bool = False) -> DataFrame:
    """All pairs with low <= sim < high (same: of one set, a, q_id < n_id); low above 0. Both sides are compared block by
    block, a set with itself meeting each two blocks once; as rows, lists or blocks."""
    if not same:
        return similar(a, b, low=low).where(F.col("sim") < high)
    return pairs_within(written(a, True), low).where(F.col("sim") < high)


def pair_dot(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(q_id, n_id, sim) for given pairs; pairs that share no term have sim 0. Each row's terms travel as packed
    lists (hashes of 64 bits and weights), not as a row for each pair and term."""

    def lists(rows: DataFrame, name: str, t: str, w: str) -> DataFrame:
        if "t" in rows.columns:
            return rows.select(F.col("id").alias(name), F.col("t").alias(t), F.col("w").alias(w))
        return rows.withColumn("__t", F.xxhash64("term")).groupBy(F.col("id").alias(name)).agg(F.collect_list("__t").alias(t), F.collect_list(F.col("w").cast("double")).alias(w))

    asked = pairs.select("q_id", "n_id")
    rows = asked.distinct().join(lists(a, "q_id", "tq", "wq"), "q_id").join(lists(b, "n_id", "tn", "wn"), "n_id").select("q_id", "n_id", "tq", "wq", "tn", "wn")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = {}
            for t, w in (("tq", "wq"), ("tn", "wn")):
                sizes = np.diff(np.asarray(batch.column(t).offsets))
                side[t] = np.repeat(np.arange(batch.num_rows), sizes), batch.column(t).flatten().to_numpy(), batch.column(w).flatten().to_numpy()
            (i, t, x), (j, u, y) = side["tq"], side["tn"]
            order, other = np.lexsort((t, i)), np.lexsort((u, j))
            keys, code = np.unique(np.concatenate([t[order], u[other]]), return_inverse=True)
            mine, theirs = i[order] * len(keys) + code[: len(t)], j[other] * len(keys) + code[len(t) :]
            at = np.minimum(np.searchsorted(mine, theirs), max(len(mine) - 1, 0))
            met = np.flatnonzero(mine[at] == theirs) if len(mine) else np.zeros(0, np.int64)
            dot = np.bincount(j[other][met], x[order][at[met]] * y[other][met], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("q_id"), batch.column("n_id"), pa.array(dot)], ["q_id", "n_id", "dot"])

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(dots, f"q_id {kinds['q_id']}, n_id {kinds['n_id']}, dot double")
    return asked.join(found, ["q_id", "n_id"], "left").select("q_id", "n_id", F.coalesce("dot", F.lit(0.0)).alias("sim"))


def guard_sims(pool_tfidf: DataFrame, eval_tfidf: DataFrame, pool_dense: DataFrame | None = None, eval_dense: DataFrame | None = None, low: float | None = None) -> DataFrame:
    """(id, sparse, dense): nearest evaluation row of each pool row in both views. low: similarities
    below it don't matter and may count as 0, so common terms need not be joined."""
    if low is None:
        near = max_sim(pool_tfidf, eval_tfidf).select("id", F.col("sim").alias("sparse"))
    else:
        best = sim_join(pool_tfidf, eval_tfidf, low, 2.0).groupBy(F.col("q_id").alias("id")).agg(F.max("sim").alias("sparse"))
        near = _ids(pool_tfidf).join(best, "id", "left").select("id", F.coalesce("sparse", F.lit(0.0)).alias("sparse"))
    if pool_dense is None:
        return near.withColumn("dense", F.lit(None).cast("double"))
    dense = dense_topk(pool_dense, eval_dense, 1).select(F.col("q_id").alias("id"), F.col("sim").alias("dense"))
    return near.join(dense, "id", "left")


def dropped(thr_sparse: float | None, thr_dense: float | None) -> tuple[Column, Column]:
    """Whether the sparse and the dense view drop a row (>= threshold)."""
    no = F.lit(False)
    by_sparse = F.coalesce(F.col("sparse") >= thr_sparse, no) if thr_sparse is not None else no
    by_dense = F.coalesce(F.col("dense") >= thr_dense, no) if thr_dense is not None else no
    return by_sparse, by_dense


def leak_guard(pool: DataFrame, sims: DataFrame, thr_sparse: float | None = 0.60, thr_dense: float | None = 0.988) -> DataFrame:
    """Pool rows that no evaluation row is too near to."""
    by_sparse, by_dense = dropped(thr_sparse, thr_dense)
    return pool.join(sims.where(by_sparse | by_dense).select("id"), "id", "left_anti")


def guard_summary(sims: DataFrame, thr_sparse: float | None = 0.60, thr_dense: float | None = 0.988) -> DataFrame:
    by_sparse, by_dense = dropped(thr_sparse, thr_dense)
    return sims.agg(
        F.count("*").alias("n"),
        F.count_if(by_sparse).alias("dropped_sparse"),
        F.count_if(by_dense & ~by_sparse).alias("dropped_dense_only"),
        F.count_if(~(by_sparse | by_dense)).alias("n_kept"),
    )


def guard_sweep(sims: DataFrame, grid: list[tuple[float | None, float | None]]) -> DataFrame:
    """One summary per setting, from one table of similarities."""
    steps = F.array(*[F.struct(F.lit(s).cast("double").alias("thr_sparse"), F.lit(e).cast("double").alias("thr_dense")) for s, e in grid])
    rows = sims.select("sparse", "dense", F.inline(steps))
    out = F.coalesce(F.col("sparse") >= F.col("thr_sparse"), F.lit(False)) | F.coalesce(F.col("dense") >= F.col("thr_dense"), F.lit(False))
    return rows.groupBy("thr_sparse", "thr_dense").agg(F.count("*").alias("n"), F.count_if(out).alias("n_dropped"))


def guard_extra(extra: DataFrame, reference: DataFrame, sims: DataFrame, thr: float = 0.95) -> DataFrame:
    """Rows of an extra pool that neither equal a reference text nor come near one (sims: id, sim)."""
    rows = extra.join(reference.select("text").distinct(), "text", "left_anti")
    return rows.join(sims.where(F.col("sim") >= thr).select("id"), "id", "left_anti")


def candidates(views: dict[str, tuple[DataFrame, DataFrame]], k: int) -> DataFrame:
    """Union of the top k of all views (as rows, lists or blocks); every view's similarity, rank and margin to the query's best."""
    tops = {name: sparse_topk(a, b, k).select("q_id", "n_id", F.col("sim").alias(name)) for name, (a, b) in views.items()}
    found = None
    for top in tops.values():
        pairs = top.select("q_id", "n_id")
        found = pairs if found is None else found.union(pairs)
    found = found.distinct()
    for name, (a, b) in views.items():
        # What a view found itself has its similarity; only the other views' pairs are looked up.
        others = found.select("q_id", "n_id").join(tops[name], ["q_id", "n_id"], "left_anti")
        looked_up = dots(others, a, b) if "block" in a.columns else pair_dot(others, a, b).select("q_id", "n_id", F.round("sim", PLACES))
        sims = tops[name].union(looked_up)
        by = W.partitionBy("q_id")
        found = found.join(sims, ["q_id", "n_id"]).withColumns({f"{name}_rank": F.rank().over(by.orderBy(F.desc(name))), f"{name}_margin": F.round(F.max(name).over(by) - F.col(name), PLACES)})
    return found


def pair_extras(pairs: DataFrame, texts: DataFrame, rare: DataFrame) -> DataFrame:
    """Length ratio, shared rare tokens (count and share of the smaller set) and difference of
    sentence counts of pairs; texts (id, text), rare (id, rare)."""
    facts = texts.join(rare, "id", "left").select("id", F.length("text").alias("n"), F.size(X.sentences(F.col("text"))).alias("s"), F.coalesce("rare", F.array().cast("array<string>")).alias("r"))
    a = facts.select(F.col("id").alias("q_id"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("r").alias("ra"))
    b = facts.select(F.col("id").alias("n_id"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("r").alias("rb"))
    rows = pairs.join(a, "q_id").join(b, "n_id").withColumn("shared", F.size(F.array_intersect("ra", "rb")).cast("long"))
    least = F.least(F.size("ra"), F.size("rb"))
    return rows.select(
        "q_id",
        "n_id",
        F.round(F.least("na", "nb") / F.greatest("na", "nb"), PLACES).alias("length_ratio"),
        "shared",
        F.round(F.col("shared") / F.greatest(least, F.lit(1)), PLACES).alias("shared_share"),
        F.abs(F.col("sa") - F.col("sb")).cast("long").alias("sentence_gap"),
    )


def class_candidates(nbrs: DataFrame) -> DataFrame:
    """Best candidate per (q_id, class): its id, its similarity, the count, mean and second best."""
    order = F.struct("sim", (-F.col("n_id")).alias("back"))
    sims = F.sort_array(F.collect_list("sim"), asc=False)
    return nbrs.groupBy("q_id", "class").agg(
        F.max_by("n_id", order).alias("n_id"), F.max("sim").alias("sim"), F.count("*").alias("cnt"), F.round(F.avg("sim"), PLACES + 2).alias("mean_sim"), F.get(sims, F.lit(1)).alias("second_sim")
    )


def attach_meta(df: DataFrame, raw: DataFrame, key: str = "text", order: str = "id") -> DataFrame:
    """Left join to the first raw row with the same text."""
    rest = [c for c in raw.columns if c != key]
    first = raw.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("raw"))
    return df.join(first.select(key, *[F.col("raw")[c].alias(f"raw_{c}") for c in rest]), key, "left")


def corrected_texts(predictions: DataFrame, feedback: DataFrame, excluded: list) -> DataFrame:
    """(text, label): the newest correction of each text, without excluded keys."""
    fb = feedback.select(F.col("ticket_id").alias("id"), F.col("created_at").alias("at"), F.col("id").alias("fb_id"), "correct_queue", "api_key")
    rows = predictions.select("id", "text").join(fb, "id").where(~F.col("api_key").isin(excluded))
    return rows.groupBy("text").agg(F.max_by("correct_queue", F.struct("at", "fb_id")).alias("label"))


def orphan_feedback(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    return feedback.join(predictions.select(F.col("id").alias("ticket_id")), "ticket_id", "left_anti")


def bad_class(feedback: DataFrame, labels: DataFrame) -> DataFrame:
    return feedback.join(labels.select(F.col("queue").alias("correct_queue")), "correct_queue", "left_anti")


def twin_check(nbrs: DataFrame, meta: DataFrame, bands: list[tuple[float, float]], columns: tuple[str, ...]) -> DataFrame:
    """Share of nearest neighbours whose metadata are identical (nulls equal), by band of similarity."""
    a = meta.select(F.col("id").alias("q_id"), F.struct(*columns).alias("ma"))
    b = meta.select(F.col("id").alias("n_id"), F.struct(*columns).alias("mb"))
    rows = nbrs.where(F.col("rank") == 1).join(a, "q_id").join(b, "n_id")
    return in_bands(rows, "sim", bands).groupBy("low").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ma").eqNullSafe(F.col("mb")).cast("double")), PLACES).alias("twin_share"))


def in_bands(df: DataFrame, column: str, bands: list[tuple[float, float]]) -> DataFrame:
    """Add low, the lower edge of the band [low, high) that holds the value; others go."""
    low = F.coalesce(*[F.when((F.col(column) >= lo) & (F.col(column) < hi), F.lit(float(lo))) for lo, hi in bands])
    return df.withColumn("low", low).where(F.col("low").isNotNull())


def fuse(views: DataFrame, how: str, dense: list[str], lexical: list[str], weight: float = 5.0) -> Column:
    """Similarity of several views' columns: sum (lexical + weight * mean of the dense), mean,
    max, convex (weight of dense against lexical) or power (product of powers)."""
    mean = lambda cs: sum((F.col(c) for c in cs), F.lit(0.0)) / len(cs)
    if how == "sum":
        return mean(lexical) + weight * mean(dense)
    if how == "mean":
        return mean([*lexical, *dense])
    if how == "max":
        return F.greatest(*[F.col(c) for c in (*lexical, *dense)])
    if how == "convex":
        return weight * mean(dense) + (1 - weight) * mean(lexical)
    if how == "power":
        return F.pow(F.greatest(mean(dense), F.lit(0.0)), weight) * F.pow(F.greatest(mean(lexical), F.lit(0.0)), 1 - weight)
    raise ValueError(how)


#: Classes that answers are compared with.
MOST_CLASSES = 10_000


def match_labels(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): the class that a free answer names exactly, else one that it begins with or
    that begins with it (the first in order), else null. labels (queue, label) is the class list: every answer is
    compared with every class, so a list of more than MOST_CLASSES is refused."""
    if labels.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError("too many classes to compare every answer with")
    text = F.lower(F.trim("answer"))
    name = F.lower("queue")
    exact = text == name
    hit = exact | ((text != "") & (F.startswith(text, name) | F.startswith(name, text)))
    rows = answers.join(labels, hit, "left").withColumn("exact", exact)
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("exact"), "label"))
    return rows.withColumn("n", best).where(F.col("n") == 1).select("id", "answer", "label")
