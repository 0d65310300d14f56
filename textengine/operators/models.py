"""Distributed models on spark.ml (MD) and plug-in encoders (PF-22)."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textengine.scratch import drop_table, materialize, shared_dir

from .decide import normalize
from .split import assign_folds


def hash_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without weights: words in buckets by the first 32 bits of their md5, signed by
    the next four, L2-normalized."""

    def encode(texts: list[str]) -> np.ndarray:
        out, seen = np.zeros((len(texts), size)), {}
        for row, t in zip(out, texts):
            for w in t.split():
                if w not in seen:
                    digest = hashlib.md5(w.encode()).hexdigest()
                    seen[w] = int(digest[:8], 16) % size, 1.0 if digest[8] < "8" else -1.0
                bucket, sign = seen[w]
                row[bucket] += sign
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return encode


def letter_encoder(letters: str = "abcdefghijklmnopqrstuvwxyz") -> Callable[[list[str]], np.ndarray]:
    """An encoder that counts letters, L2-normalized."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.array([[t.count(c) for c in letters] for t in texts], float).reshape(len(texts), len(letters))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return encode


def embed(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], cache: DataFrame | None = None) -> DataFrame:
    """(id, vec) of rows (id, text). Texts whose sha1 is in the cache (key, vec) are not encoded."""
    keyed = df.select("id", F.sha1("text").alias("key"), "text")
    todo = keyed.dropDuplicates(["key"]).select("key", "text")
    if cache is not None:
        todo = todo.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"key": part["key"], "vec": list(encoder(part["text"].fillna("").tolist()))})

    found = todo.mapInPandas(run, "key string, vec array<double>")
    if cache is not None:
        found = found.unionByName(cache.select("key", F.col("vec").cast("array<double>").alias("vec")))
    return keyed.select("id", "key").join(found, "key").select("id", "vec")


def text_features(df: DataFrame, size: int = 1 << 12) -> DataFrame:
    """Add features: hashed TF-IDF of the words of text."""
    words = df.withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return Pipeline(stages=[HashingTF(inputCol="words", outputCol="tf", numFeatures=size), IDF(inputCol="tf", outputCol="features", minDocFreq=2)]).fit(words).transform(words).drop("tf", "words")


def fit_logreg(df: DataFrame, c: float = 1.0, balanced: bool = False):
    n = max(1, df.count())
    lr = LogisticRegression(family="multinomial", regParam=1 / (c * n), standardization=False, maxIter=25, labelCol="label")
    if balanced:
        counts = df.groupBy("label").agg((F.lit(float(n)) / F.count("*")).alias("weight"))
        df, lr = df.join(counts, "label"), lr.setWeightCol("weight")
    return lr.fit(df)


def fit_nb(df: DataFrame, kind: str = "complement", alpha: float = 1.0):
    return NaiveBayes(modelType=kind, smoothing=alpha, labelCol="label").fit(df)


def fit_svm(df: DataFrame, c: float = 1.0):
    return OneVsRest(classifier=LinearSVC(regParam=1 / (c * max(1, df.count())), maxIter=10), labelCol="label").fit(df)


def predict_labels(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))


def assemble(rows: DataFrame, columns: list[str], categories: dict[str, int] | None = None) -> DataFrame:
    """Add features. categories: columns that hold numbers of so many classes, which trees split by sets."""
    for c, n in (categories or {}).items():
        rows = rows.withColumn(c, F.col(c).cast("double")).withMetadata(c, {"ml_attr": {"type": "nominal", "num_vals": n}})
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(rows)


#: Fixed values of the stacker: rounds, rate, depth, rows of a leaf.
ROUNDS, RATE, DEPTH, LEAF_ROWS = 300, 0.06, 5, 40


def fit_stacker(rows: DataFrame, columns: list[str], rounds: int = ROUNDS, depth: int = DEPTH, valid: str | None = None, categories: dict[str, int] | None = None):
    """Boosted trees on (query, class) rows with a 0/1 label; valid names an early-stopping flag. The
    rows are written once; the lineage of the rounds is cut by checkpoints in spark.checkpoint.dir."""
    spark, bins = rows.sparkSession, max([32, *(categories or {}).values()])
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    gbt = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=RATE, minInstancesPerNode=LEAF_ROWS, maxBins=bins, checkpointInterval=20, seed=1)
    if valid:
        gbt = gbt.setValidationIndicatorCol(valid)
    table, path = materialize(rows.select(*columns, "label", *([valid] if valid else [])), "stacker-rows")
    model = gbt.fit(assemble(table, columns, categories))
    drop_table(spark, path)
    return model


def predict_stacker(model, rows: DataFrame, columns: list[str], categories: dict[str, int] | None = None) -> DataFrame:
    """(q_id, class, p): positive scores, normalized within the query."""
    scored = model.transform(assemble(rows, columns, categories)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return normalize(scored)


def fit_flat(rows: DataFrame, columns: list[str], trees: int = 20):
    """One row per query, all classes' evidence as columns, a forest over the classes."""
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=6, seed=1).fit(assemble(rows, columns))


def class_prototypes(df: DataFrame, total: int, steps: int = 10, seed: int = 1) -> DataFrame:
    """(class, vec): spherical k-means inside every class at once, k in proportion to the class's size.

    It begins with the rows of a class whose hashes are least. A step sends each row to the nearest centre of
    its class and adds rows up per centre, inside tasks first; a centre without rows stays. The
    driver and each task hold the centres (about `total` vectors), never rows.
    """
    rows = df.where(F.col("vec").isNotNull()).select("class", F.col("vec").cast("array<double>").alias("vec"))
    n = F.sum(F.count("*")).over(W.partitionBy())
    sizes = rows.groupBy("class").agg(F.greatest(F.lit(1), F.round(F.lit(total) * F.count("*") / n)).alias("k"))
    place = F.row_number().over(W.partitionBy("class").orderBy(F.xxhash64("vec", F.lit(seed)), "vec"))
    heads = rows.withColumn("place", place).where(F.col("place") <= total).join(sizes, "class").where(F.col("place") <= F.col("k"))
    centres: dict[int, np.ndarray] = {}
    for r in heads.orderBy("class", "place").collect():
        centres.setdefault(r["class"], []).append(r["vec"])
    centres = {c: _unit_rows(np.array(v)) for c, v in centres.items()}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for part in batches:
            for c, vecs in part.groupby("class")["vec"]:
                m = _unit_rows(np.stack(vecs.to_list()))
                near = (m @ centres[c].T).argmax(1)
                for j in np.unique(near):
                    sums[c, int(j)] = sums.get((c, int(j)), 0) + m[near == j].sum(0)
        yield pd.DataFrame([(c, j, i, x) for (c, j), v in sums.items() for i, x in enumerate(v.tolist())], columns=["class", "j", "i", "x"])

    for _ in range(steps if centres else 0):
        found = rows.mapInPandas(add, f"class {rows.schema['class'].dataType.simpleString()}, j int, i int, x double").groupBy("class", "j", "i").agg(F.sum("x").alias("x")).collect()
        fresh = {c: v.copy() for c, v in centres.items()}
        for r in found:
            fresh[r["class"]][r["j"], r["i"]] = r["x"]
        centres = {c: _unit_rows(v) for c, v in fresh.items()}
    out = [(c, v) for c in sorted(centres) for v in centres[c].tolist()]
    return df.sparkSession.createDataFrame(out, f"class {rows.schema['class'].dataType.simpleString()}, vec array<double>")


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def grid_search(df: DataFrame, cs: list[float], folds: int = 3) -> DataFrame:
    """(c, accuracy) of logistic regression by cross-validation, configurations side by side."""
    n = max(1, df.count())
    lr = LogisticRegression(labelCol="label", maxIter=10)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1 / (c * n) for c in cs]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, parallelism=2, seed=1)
    return df.sparkSession.createDataFrame([(float(c), float(a)) for c, a in zip(cs, cv.fit(df).avgMetrics)], "c double, accuracy double")


def block_ablation(df: DataFrame, blocks: dict[str, list[str]], k: int = 2) -> DataFrame:
    """(block, n, accuracy): logistic regression on each set of columns, cross-validated over k folds."""
    # The columns may come from texts: they are made once, not for each pass of a fit.
    needed = dict.fromkeys(["id", "label", *[c for columns in blocks.values() for c in columns]])
    rows, _ = materialize(assign_folds(df.select(*needed), "label", k, 1), "ablation-rows")
    out = None
    for name, columns in blocks.items():
        for f in range(k):
            parts = assemble(rows, columns)
            got = predict_labels(fit_logreg(parts.where(F.col("fold") != f)), parts.where(F.col("fold") == f)).withColumn("block", F.lit(name))
            out = got if out is None else out.unionAll(got)
    return out.groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("y")).cast("double")), 4).alias("accuracy"))


def column_ablation(train: DataFrame, test: DataFrame, sets: dict[str, list[str]], rounds: int = ROUNDS) -> DataFrame:
    """(columns, n, accuracy) of the stacker for each set of columns."""
    from .decide import decide

    out = None
    for name, columns in sets.items():
        got = decide(predict_stacker(fit_stacker(train, columns, rounds), test, columns), 0.7).select("q_id", "pred", F.lit(name).alias("columns"))
        out = got if out is None else out.unionAll(got)
    truth = test.where(F.col("label") == 1).select("q_id", F.col("class").alias("y"))
    return out.join(truth, "q_id").groupBy("columns").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("y")).cast("double")), 4).alias("accuracy"))


def lcs_length(x: list, y: list) -> int:
    """Longest common subsequence, with a bit for each item of the shorter list: the row of the usual
    table is kept as the set of places where it doesn't grow, and a whole row is one addition."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    places: dict = {}
    for i, w in enumerate(short):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(short)) - 1
    still = whole
    for w in long:
        hit = still & places.get(w, 0)
        if hit:
            still = ((still + hit) | (still - hit)) & whole
    return len(short) - still.bit_count()


def lcs_ratio(pairs: DataFrame, a: str, b: str, least: float = 0.0) -> DataFrame:
    """Add ratio: 2 LCS / (|a| + |b|) of the words of two text columns, on given pairs only. The words
    that both have, counted, bound it; pairs whose bound is 0 or below `least` are not compared, and those
    below `least` get null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for x, y in zip(part[a], part[b]):
                x, y = (x or "").split(), (y or "").split()
                total = max(1, len(x) + len(y))
                bound = (Counter(x) & Counter(y)).total()
                out.append(None if 2 * bound / total < least else 2 * (lcs_length(x, y) if bound else 0) / total)
            yield part.assign(ratio=pd.Series(out, part.index, float))

    from pyspark.sql import types as T

    return pairs.mapInPandas(run, T.StructType([*pairs.schema.fields, T.StructField("ratio", T.DoubleType())]))
