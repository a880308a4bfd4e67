"""Boosted trees (G1) and their importances (V6) on ``pyspark.ml``.

Parameter mapping from the reference's booster: max_depth -> maxDepth,
learning_rate -> stepSize, n_estimators -> maxIter, subsample ->
subsamplingRate, colsample_bytree -> featureSubsetStrategy (a fraction, drawn
per node rather than per tree), scale_pos_weight -> a row weight on the
positive class. Second-order boosting is not reproduced: compare AUC.
"""

from __future__ import annotations

import itertools
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.operators import boosting
from churnlens.operators import metrics as M
from churnlens.session import checkpoint_dir, scratch_path, ship_package, write_table, written

# The reference's tuned booster.
BEST = dict(max_depth=3, learning_rate=0.05, n_estimators=200, subsample=1.0, colsample=0.8)


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


#: Training rows that a task holds at least (below, its start costs more than its rows) and at most.
TASK_ROWS = (16_384, 1_000_000)


def dealt(train: DataFrame, features, label: str = "Left") -> DataFrame:
    """The training rows; features and label written in equal parts, if they are more than a task's.

    Boosting runs a job a level of each tree on the partitions that it was
    given, so uneven ones (files of a filtered or joined table) make the
    largest one's task the time of hundreds of jobs.
    """
    spark = train.sparkSession
    rows, (least, most) = train.count(), TASK_ROWS
    if rows <= least:
        return train
    n = min(spark.sparkContext.defaultParallelism, math.ceil(rows / least))
    n *= math.ceil(rows / (n * most))
    return written(train.select(*features, label).repartition(n).sortWithinPartitions(*features, label), "gbt-train")


def gbt_fit(train: DataFrame, features, label: str = "Left", max_depth: int = 3, learning_rate: float = 0.05,
            n_estimators: int = 200, subsample: float = 1.0, colsample: float = 0.8, pos_weight=None,
            seed: int = 17, deal: bool = True):
    """G1: fit ``GBTClassifier``; ``pos_weight`` (n0/n1) weights positive rows. ``deal``: the rows are not yet in equal parts (:func:`dealt`)."""
    checkpoint_dir(train.sparkSession)            # tree checkpoints go to the shared folder
    train = dealt(train, features, label) if deal else train
    d = assemble(train, features).withColumn("label", F.col(label).cast("double"))
    kw = dict(maxDepth=max_depth, stepSize=learning_rate, maxIter=n_estimators, subsamplingRate=subsample,
              featureSubsetStrategy="all" if colsample >= 1 else str(colsample), seed=seed, maxBins=64,
              checkpointInterval=10, cacheNodeIds=False)
    if pos_weight is not None:
        d = d.withColumn("w", F.when(F.col("label") == 1, F.lit(float(pos_weight))).otherwise(1.0))
        kw["weightCol"] = "w"
    return GBTClassifier(**kw).fit(d)


def gbt_score(model, df: DataFrame, features) -> DataFrame:
    """Adds ``prob`` (P(class 1)) and ``margin`` (log-odds = 2 rawPrediction[1])."""
    s = model.transform(assemble(df, features))
    return s.withColumn("prob", vector_to_array("probability")[1]) \
        .withColumn("margin", 2 * vector_to_array("rawPrediction")[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")


def tree_importance(model, features, spark) -> DataFrame:
    """V6: (feature, importance) sorted descending; importances sum to 1."""
    imp = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc())


# ---- the fitted ensemble as a table ------------------------------------------

def node_table(model) -> DataFrame:
    """One row per node of a fitted ensemble: ``tree``, ``weight``, ``node``, ``feature`` (null for a leaf), ``threshold``
    (left if at most), ``left``, ``right``, ``prediction``, ``gain`` and ``count`` (rows that reached it).

    Spark saves an ensemble as such a table; it is written beside the
    checkpoints and read from there.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, f"trees-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    d, meta = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight")
    leaf = F.col("nodeData.leftChild") < 0
    nodes = d.select(F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.when(~leaf, F.col("nodeData.split.featureIndex")).alias("feature"),
                     F.when(~leaf, F.col("nodeData.split.leftCategoriesOrThreshold")[0]).alias("threshold"), F.when(~leaf, F.col("nodeData.leftChild")).alias("left"),
                     F.when(~leaf, F.col("nodeData.rightChild")).alias("right"), F.col("nodeData.prediction").alias("prediction"),
                     F.when(~leaf, F.col("nodeData.gain")).alias("gain"), F.col("nodeData.rawCount").alias("count"))
    return nodes.join(meta.select("tree", "weight"), "tree")


def split_gain(nodes: DataFrame, features) -> DataFrame:
    """V6 as the reference's booster counts it: per feature the number of splits, their average gain, and its share.

    A split's gain is its decrease of impurity times the rows that it parts;
    features without a split have gain 0.
    """
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    g = nodes.where("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n_splits"), F.avg(F.col("gain") * F.col("count")).alias("average_gain"))
    j = names.join(g, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("n_splits", F.lit(0)).alias("n_splits"), F.coalesce("average_gain", F.lit(0.0)).alias("average_gain"))
    total = j.agg(F.sum("average_gain")).scalar()
    return j.withColumn("importance", F.coalesce(F.try_divide(F.col("average_gain"), total), F.lit(0.0)))


def importances(model, features, spark) -> DataFrame:
    """Both importances side by side: Spark's (gain summed by tree, normalised) and the average gain."""
    return tree_importance(model, features, spark).withColumnRenamed("importance", "summed_gain").join(
        split_gain(node_table(model), features).withColumnRenamed("importance", "gain_share"), "feature").orderBy(F.col("gain_share").desc(), "feature")


class StagedTrees:
    """The trees of an ensemble as arrays, small enough for every task: trees x nodes numbers."""

    def __init__(self, nodes: DataFrame):
        rows = nodes.toPandas().sort_values(["tree", "node"])       # the model itself: too small to be worth a shuffle
        self.trees = []
        for _, t in rows.groupby("tree", sort=True):
            at = {n: i for i, n in enumerate(t["node"])}
            leaf = t["feature"].isna().to_numpy()
            child = lambda c: np.array([at[int(x)] if not pd.isna(x) else i for i, x in enumerate(t[c])], dtype=np.int32)  # noqa: E731, B023
            self.trees.append((float(t["weight"].iloc[0]), t["feature"].fillna(0).to_numpy(np.int32), np.where(leaf, np.inf, t["threshold"].fillna(0).to_numpy(np.float64)),
                               child("left"), child("right"), t["prediction"].to_numpy(np.float64)))

    def margins(self, x: np.ndarray, stages) -> np.ndarray:
        """Log-odds of class 1 after the first k trees, for each k of ``stages``: one column each."""
        out, total, done = np.empty((len(x), len(stages))), np.zeros(len(x)), 0
        order = np.argsort(stages, kind="stable")
        for s in order:
            for weight, feature, threshold, left, right, prediction in self.trees[done:stages[s]]:
                at = np.zeros(len(x), dtype=np.int32)
                while True:
                    go = np.where(x[np.arange(len(x)), feature[at]] <= threshold[at], left[at], right[at])
                    if (go == at).all():
                        break
                    at = go
                total += weight * prediction[at]
            done = max(done, min(stages[s], len(self.trees)))
            out[:, s] = 2 * total
        return out


def staged_scores(model, df: DataFrame, features, stages) -> DataFrame:
    """``df`` with ``margins``: the log-odds after each of ``stages`` trees, all in one pass."""
    ship_package(df.sparkSession)
    shared, stages = df.sparkSession.sparkContext.broadcast(StagedTrees(node_table(model))), list(stages)

    @F.pandas_udf("array<double>")
    def margins(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(np.float64) for c in cols])
        return pd.Series(list(shared.value.margins(x, stages)))

    return df.withColumn("margins", margins(*[F.col(c).cast("double") for c in features]))


# ---- grids ---------------------------------------------------------------------

# The reference's two tree grids, for tuning (108 points) and for the rebalancing experiment (162),
# keys in the order in which its library varies them.
TUNING_GRID = dict(colsample=[0.8, 1.0], learning_rate=[0.1, 0.01, 0.05], max_depth=[3, 5, 7], n_estimators=[100, 200, 300], subsample=[0.8, 1.0])
REBALANCING_GRID = dict(colsample=[0.8, 0.9, 1.0], learning_rate=[0.01, 0.05, 0.1], max_depth=[3, 4, 5], n_estimators=[100, 200],
                        subsample=[0.8, 0.9, 1.0])


def staged_fits(grid: dict) -> list[dict]:
    """The fits that a grid needs: one a point of the other parameters, with the most trees asked for."""
    rest = {k: v for k, v in grid.items() if k != "n_estimators"}
    return [dict(zip(rest, v)) | {"n_estimators": max(grid["n_estimators"])} for v in itertools.product(*rest.values())]


def fold_parts(train: DataFrame, features, label: str = "Left", fold_col: str = "fold", prepare=None) -> dict:
    """For each fold the training rows (:func:`dealt`), the held-out rows and the weight, as ``prepare`` leaves them; written once, for any number of grids."""
    parts = {}
    for f in sorted(r[0] for r in train.select(F.col(fold_col).cast("int")).distinct().collect()):     # k numbers
        tr, va = train.where(F.col(fold_col) != f), train.where(F.col(fold_col) == f)
        tr, va, weight = prepare(tr, va) if prepare else (tr, va, None)
        parts[f] = dealt(written(tr.select(*features, label), "gbt-rows"), features, label), written(va.select(*features, label), "gbt-held-out"), weight
    return parts


def grown_scores(parts: dict, features, label: str, fits: list[dict], stages: list[int], seed: int = 17) -> DataFrame:
    """(fit, fold, stage, y, score) of the held-out rows of every fold from every fit, its ensembles grown in tasks (``boosting``).

    A fold is packed once, in an order that its rows fix, and goes to as many
    tasks as share out its fits.
    """
    spark, k = next(iter(parts.values()))[0].sparkSession, len(features)
    ship_package(spark)
    weights = {f: w for f, (_, _, w) in parts.items()}
    rows = reduce(DataFrame.unionAll, [d.select(F.lit(f).alias("fold"), F.lit(out).alias("out"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
                                       for f, p in parts.items() for out, d in enumerate(p[:2])])
    bad = rows.agg(F.max(F.greatest(*[(F.col(f"x{j}").isNull() | F.isnan(f"x{j}")).cast("int") for j in range(k)], F.col("y").isNull().cast("int")))).first()[0]
    if bad:
        raise ValueError("features and labels must not be missing")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        f, x, y = int(pdf["fold"].iloc[0]), pdf[[f"x{j}" for j in range(k)]].to_numpy(np.float64), pdf["y"].to_numpy(np.int8)
        at = np.lexsort([*x.T, y, pdf["out"].to_numpy()])
        x, y, n = x[at], y[at], int((pdf["out"] == 0).sum())
        weight = None if weights[f] is None else np.where(y[:n] == 1, float(weights[f]), 1.0)
        cuts = [boosting.thresholds(x[:n, j], weight) for j in range(k)] if n else [np.zeros(0)] * k
        return pd.DataFrame({"fold": [f], "n": [n], "y": [y.tobytes()], "bins": [boosting.binned(x, cuts).tobytes()], "splits": [[len(c) for c in cuts]]})

    packed = written(rows.groupBy("fold").applyInPandas(pack, "fold int, n long, y binary, bins binary, splits array<int>"), "gbt-packed")
    order = sorted(range(len(fits)), key=lambda i: -fits[i]["max_depth"])
    share = min(len(fits), math.ceil(4 * spark.sparkContext.defaultParallelism / max(1, len(parts))))
    slots = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
    slots = slots.repartitionByRange(share * len(parts), "part", "fold")       # a task each

    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                y = np.frombuffer(row.y, np.int8)
                bins = np.frombuffer(row.bins, np.uint8).reshape(k, len(y))
                for i in order[row.part::share] if 0 < row.n < len(y) else []:
                    p = fits[i]
                    m = boosting.staged_margins(bins, np.array(row.splits), y, row.n, stages, p["max_depth"], p["learning_rate"], p["subsample"], p["colsample"], weights[row.fold], seed)
                    for stage, score in enumerate(m):
                        yield pd.DataFrame({"fit": np.int32(i), "fold": np.int32(row.fold), "stage": np.int32(stage), "y": y[row.n:].astype(np.int32), "score": np.round(score, 9)})

    return slots.mapInPandas(run, "fit int, fold int, stage int, y int, score double")


def gbt_grid(train: DataFrame, features, label: str = "Left", fold_col: str = "fold", grid: dict | None = None,
             parallelism: int = 8, seed: int = 17, prepare=None, parts: dict | None = None) -> DataFrame:
    """V1 for trees: mean and population sd of the fold AUC of every grid point, with ``rank``.

    Boosting adds trees one after the other, so one fit of the most trees
    serves every number of trees: its prefixes are scored in one pass over the
    held-out fold. Where a fold's training rows are no more than a task's, tasks
    grow whole ensembles (:func:`grown_scores`); else Spark's fits run side by
    side, ``parallelism`` at a time. Ties
    go to the first point in the order of the grid's keys. ``prepare(train,
    held_out)`` may change both parts of a fold (resample, scale) and give a
    weight for the positive class: it returns (train, held_out, pos_weight).
    ``parts`` are folds that :func:`fold_parts` has prepared already.
    """
    spark, grid = train.sparkSession, grid or TUNING_GRID
    checkpoint_dir(spark)
    ship_package(spark)             # before the fits run side by side
    stages, fits = sorted(grid["n_estimators"]), staged_fits(grid)
    parts = parts or fold_parts(train, features, label, fold_col, prepare)

    def one(job):
        i, f = job
        tr, va, weight = parts[f]
        model = gbt_fit(tr, features, label, pos_weight=weight, seed=seed, deal=False, **fits[i])
        s = staged_scores(model, va, features, stages).select(F.posexplode("margins").alias("stage", "score"), F.col(label).cast("int").alias("y"))
        return write_table(s.select(F.lit(i).alias("fit"), F.lit(f).alias("fold"), "stage", "y", F.round("score", 9).alias("score")), "gbt-scores")

    if max((tr.count() for tr, _, _ in parts.values()), default=0) <= TASK_ROWS[1]:
        paths = [write_table(grown_scores(parts, features, label, fits, stages, seed), "gbt-scores")]
    else:
        with ThreadPoolExecutor(parallelism) as pool:
            paths = list(pool.map(one, itertools.product(range(len(fits)), sorted(parts))))
    auc = M.auc_by(spark.read.parquet(*paths), "score", "y", ["fit", "stage", "fold"])
    s = auc.groupBy("fit", "stage").agg(F.round(F.avg("auc"), 12).alias("mean_auc"), F.round(F.stddev_pop("auc"), 9).alias("std_auc"))
    rows = []
    for point, values in enumerate(itertools.product(*grid.values())):
        p = dict(zip(grid, values))
        fit = next(i for i, x in enumerate(fits) if all(x[k] == v for k, v in p.items() if k != "n_estimators"))
        rows.append((point, fit, stages.index(p["n_estimators"]), p["max_depth"], float(p["learning_rate"]), p["n_estimators"], float(p["subsample"]), float(p["colsample"])))
    named = spark.createDataFrame(rows, "point int, fit int, stage int, max_depth int, learning_rate double, n_estimators int, subsample double, colsample double")
    return named.join(s, ["fit", "stage"]).drop("fit", "stage").withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_auc").desc(), "point")))


def winner(ranked: DataFrame) -> dict:
    """The parameters of the point of rank 1, as :func:`gbt_fit` takes them (the refit)."""
    r = ranked.where("rank = 1").first()
    return {k: r[k] for k in ("max_depth", "learning_rate", "n_estimators", "subsample", "colsample")}
