"""Tuning and resampled evaluation (V1-V5).

Scores come first, metrics after: a cross-validation writes one table of
(model, fold, label, score), whatever the models, and one grouped running sum
over it gives every fold's AUC, threshold, accuracy and recall. For kNN all
folds are one neighbour job (rows of the query's own fold are no neighbours),
every k and both weightings are read off the same neighbours, and a learning
curve takes its prefixes from the same tiles.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.expressions import hash_bucket, md5_hex
from churnlens.operators import metrics as M
from churnlens.operators.neighbors import knn_layers, knn_proba, knn_topk
from churnlens.operators.rank import global_cumsum, global_rank
from churnlens.session import ship_package, written


def fold_sizes(df: DataFrame, fold_col: str = "fold") -> dict[int, int]:
    """Rows of each fold (k numbers)."""
    return {int(r[0]): r[1] for r in df.groupBy(F.col(fold_col).cast("int").alias("f")).count().where("f is not null").collect()}


def knn_grid(train: DataFrame, features, label: str = "Left", key: str = "Customer_ID", fold_col: str = "fold",
             ks=tuple(range(3, 34, 2)), weights=("uniform", "distance"),
             metrics=("euclidean", "manhattan")) -> DataFrame:
    """V1 for kNN: mean and population sd of fold AUC per (metric, k, weights).

    minkowski with p = 1 or 2 equals manhattan or euclidean and is not
    recomputed. Rank 1 = best mean AUC; ties go to the first grid point in
    (metric, k, weights) order.
    """
    kmax = max(ks)
    cands = None
    for metric in metrics:
        t = knn_topk(train, train, features, k=kmax, metric=metric, query_key=key, base_key=key, carry=label, apart=fold_col) \
            .select(F.lit(metric).alias("metric"), "qid", "nid", "distance", "rank", F.col("_y").cast("int").alias("_y"))
        cands = t if cands is None else cands.unionByName(t)
    # running sums over the ranks of a query: one row a neighbour serves every k (the last one also every larger k)
    near = Window.partitionBy("metric", "qid").orderBy("rank")
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y, d = F.col("_y"), F.col("distance")
    c = cands.select("metric", "qid", "rank", F.lead("rank").over(near).isNull().alias("_last"), (F.sum(y).over(upto) / F.count(F.lit(1)).over(upto)).alias("uniform"),
                     F.sum(F.when(d == 0, 1).otherwise(0)).over(upto).alias("_z"), F.sum(F.when(d == 0, y).otherwise(0)).over(upto).alias("_zy"),
                     F.sum(F.try_divide(y, d)).over(upto).alias("_sy"), F.sum(F.try_divide(F.lit(1.0), d)).over(upto).alias("_s1"))
    own = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: (k == F.col("rank")) | (F.col("_last") & (k > F.col("rank"))))
    pr = c.select("metric", "qid", F.explode(own).alias("k"), F.round("uniform", 9).alias("uniform"),
                  F.round(F.when(F.col("_z") > 0, F.try_divide("_zy", "_z")).otherwise(F.try_divide("_sy", "_s1")), 9).alias("distance"))
    long = written(pr, "knn-grid").select("metric", "k", "qid", F.explode(F.array(
        *[F.struct(F.lit(w).alias("weights"), F.col(w).alias("proba")) for w in weights])).alias("s")) \
        .select("metric", "k", "qid", "s.*")
    truth = train.select(F.col(key).alias("qid"), F.col(fold_col).alias("_f"), F.col(label).cast("int").alias("y"))
    a = M.auc_by(long.join(truth, "qid"), "proba", "y", ["metric", "k", "weights", "_f"])
    s = a.groupBy("metric", "k", "weights").agg(F.round(F.avg("auc"), 9).alias("mean_auc"), F.round(F.stddev_pop("auc"), 9).alias("std_auc"))
    w = Window.partitionBy().orderBy(F.col("mean_auc").desc(), "metric", "k", "weights")
    return s.withColumn("rank", F.row_number().over(w))


def knn_winner(ranked: DataFrame) -> dict:
    """The parameters of rank 1 (the refit of a kNN is the whole training set)."""
    r = ranked.where("rank = 1").first()
    return dict(k=r["k"], weights=r["weights"], metric=r["metric"])


def knn_fit_score(k: int = 5, weights: str = "uniform", metric: str = "euclidean", features=None,
                  label: str = "Left", key: str = "Customer_ID"):
    """A (fit, score) pair for a kNN classifier: scoring is the neighbour job."""
    def score(train: DataFrame, rows: DataFrame) -> DataFrame:
        t = knn_topk(rows, train, features, k=k, metric=metric, query_key=key, base_key=key, carry=label)
        p = written(knn_proba(t, train, label, key, weights=weights), "knn-scores")
        return rows.join(p.withColumnRenamed("qid", key), key)
    return score


def knn_cv_scores(df: DataFrame, features, k: int, weights: str, metric: str, label: str = "Left", key: str = "Customer_ID",
                  fold_col: str = "fold", model: str = "KNN") -> DataFrame:
    """(model, fold, y, score) of every row, from its neighbours in the other folds: one job for all folds."""
    t = knn_topk(df, df, features, k=k, metric=metric, query_key=key, base_key=key, carry=label, apart=fold_col)
    p = knn_proba(t, df, label, key, weights=weights)
    truth = df.select(F.col(key).alias("qid"), F.col(fold_col).cast("int").alias("fold"), F.col(label).cast("int").alias("y"))
    # written, as the metrics read the scores several times
    return written(p.join(truth, "qid").select(F.lit(model).alias("model"), "fold", "y", F.col("proba").alias("score")), "knn-scores")


def fold_cv_scores(df: DataFrame, score_fn, label: str = "Left", fold_col: str = "fold", model: str = "model", score: str = "proba",
                   parallelism: int = 1) -> DataFrame:
    """The same for any ``score_fn(train, rows)``, one call a fold, ``parallelism`` of them at a time."""
    def one(f):
        s = score_fn(df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f))
        return s.select(F.lit(model).alias("model"), F.lit(f).alias("fold"), F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("score"))

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, sorted(fold_sizes(df, fold_col))))
    return reduce(DataFrame.unionByName, parts)


def cv_metrics(scores: DataFrame, model: str = "model", fold: str = "fold") -> DataFrame:
    """V3: (model, fold, metric, value) from scores of all models and folds, in one pass: AUC, and accuracy and recall at the fold's Youden threshold."""
    m = M.curve_metrics(scores, "score", "y", [model, fold])
    return m.select(model, fold, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in (
        ("AUC", "auc"), ("Accuracy", "accuracy"), ("Recall", "recall"), ("Threshold", "threshold"))])).alias("s")).select(model, fold, "s.*")


def cv_summary(scores: DataFrame) -> DataFrame:
    """V3: mean and population sd over the folds, by model and metric."""
    return cv_metrics(scores).groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def cross_val_auc(scores: DataFrame) -> DataFrame:
    """V2: mean of the fold AUCs and +-2 population sd, by model."""
    a = M.auc_by(scores, "score", "y", ["model", "fold"])
    return a.groupBy("model").agg(F.avg("auc").alias("mean"), (F.stddev_pop("auc") * 2).alias("plus_minus"))


LEARNING_SIZES = tuple(i / 10 for i in range(1, 11))


def train_sizes(sizes: dict[int, int], fractions=LEARNING_SIZES) -> list[int]:
    """Absolute training sizes: shares of the smallest training part, the same for every fold."""
    n_max = sum(sizes.values()) - max(sizes.values())
    return [int(round(f * n_max, 9)) for f in fractions]


def fold_positions(df: DataFrame, key: str, fold_col: str, folds) -> DataFrame:
    """``df`` with ``_pos``: for each fold the row's place in key order among the rows of the other folds (0 for its own)."""
    r = df.withColumn("_f", F.col(fold_col).cast("int"))
    for i, f in enumerate(folds):
        r = r.withColumn(f"_in{i}", (F.col("_f") != f).cast("long"))
    c = global_cumsum(r, [key], [f"_in{i}" for i in range(len(folds))])
    pos = F.array(*[F.when(F.col(f"_in{i}") == 1, F.col(f"cum__in{i}")).otherwise(0) for i in range(len(folds))])
    return c.select(*df.columns, pos.alias("_pos"))


def knn_learning_scores(df: DataFrame, features, k: int, weights: str, metric: str, label: str = "Left", key: str = "Customer_ID",
                        fold_col: str = "fold", fractions=LEARNING_SIZES, block: int = 4096, base_block: int | None = None) -> DataFrame:
    """(part, fold, train_size, y, score): each training prefix of each fold scored on itself (``train``) and on the fold (``validation``).

    The prefixes are the first rows, in key order, of the other folds. One
    search finds for every row the few rows that are among its k nearest in
    any prefix (:func:`knn_layers`); the k of each prefix are read off them.
    """
    sizes = fold_sizes(df, fold_col)
    folds = sorted(sizes)
    ends = np.array(sorted(train_sizes(sizes, fractions)))
    # per fold one byte: the first of the sizes whose prefix holds the row (their number, if none does)
    level = F.transform("_pos", lambda x: F.when(x == 0, len(ends)).otherwise(F.size(F.filter(F.array(*[F.lit(int(n)) for n in ends]), lambda n: n < x))))
    d = fold_positions(df, key, fold_col, folds).select(
        F.col(key).alias("nid"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"), F.col(label).cast("int").alias("_y"),
        F.unhex(F.array_join(F.transform(level, lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("_at"), F.col(fold_col).cast("int").alias("f"))
    d = written(d, "learning-rows")

    def members(ats) -> np.ndarray:
        """Prefixes (fold by fold) x rows."""
        at = np.frombuffer(b"".join(ats), dtype=np.uint8).reshape(len(ats), len(folds))
        return (at[:, :, None] <= np.arange(len(ends))).reshape(len(at), -1).T

    near = knn_layers(d.drop("f"), members, k, metric, block=block, base_block=base_block)
    near = near.select("qid", F.array_sort(F.transform("near", lambda x: F.struct(F.round(x["d"], 9).alias("d"), x["nid"].alias("nid"), x["y"].alias("y"), x["at"].alias("at")))).alias("nb"))
    near = near.join(d.select(F.col("nid").alias("qid"), F.col("_y").alias("y"), F.col("_at").alias("at"), "f"), "qid")
    near = near.select("y", "f", "at", *[F.col(f"nb.{c}").alias(f"n_{c}") for c in ("d", "y", "at")])
    fold_of = np.repeat(folds, len(ends))

    def scored(batches):
        for b in batches:
            out = []
            for y, f, at, nd, ny, nat in b.itertuples(index=False):
                asked = np.flatnonzero(members([at])[:, 0] | (fold_of == f))
                m = members(nat)[asked]
                m &= np.cumsum(m, axis=1) <= k
                nd, ny = np.asarray(nd), np.asarray(ny, dtype=np.float64)
                if weights == "uniform":
                    w = np.ones(len(nd))
                else:
                    w = np.divide(1.0, nd, out=np.zeros(len(nd)), where=nd > 0)
                up, all_ = (np.where(m, x, 0.0).cumsum(axis=1)[:, -1] for x in (w * ny, w))      # one after the other, as a SQL engine adds
                if weights != "uniform":
                    zero = (m & (nd == 0)).sum(axis=1)
                    up, all_ = np.where(zero > 0, (m & (nd == 0) & (ny == 1)).sum(axis=1), up), np.where(zero > 0, zero, all_)
                keep = m.any(axis=1)
                out.append(pd.DataFrame({"validation": fold_of[asked] == f, "fold": fold_of[asked], "train_size": np.tile(ends, len(folds))[asked], "y": y,
                                         "score": np.divide(up, all_, out=np.full(len(up), np.nan), where=all_ > 0)})[keep])
            if out:
                yield pd.concat(out, ignore_index=True)

    s = near.mapInPandas(scored, "validation boolean, fold int, train_size long, y int, score double")
    part = F.when(F.col("validation"), "validation").otherwise("train")
    return s.select(part.alias("part"), "fold", "train_size", "y", F.round(F.nanvl("score", F.lit(None).cast("double")), 9).alias("score"))


def learning_curve(scores: DataFrame, by: str = "accuracy") -> DataFrame:
    """V4: mean and population sd over the folds of the train and validation score (accuracy at 0.5, or AUC) by training size."""
    if by == "auc":
        v = M.auc_by(scores, "score", "y", ["part", "fold", "train_size"]).withColumnRenamed("auc", "value")
    else:
        hit = F.when((F.col("score") > 0.5).cast("int") == F.col("y"), 1).otherwise(0)
        v = scores.groupBy("part", "fold", "train_size").agg((F.sum(hit) / F.count(F.lit(1))).alias("value"))
    aggs = []
    for part, name in (("train", "train"), ("validation", "val")):
        own = F.when(F.col("part") == part, F.col("value"))
        aggs += [F.avg(own).alias(f"{name}_mean"), F.stddev_pop(own).alias(f"{name}_std")]
    return v.groupBy("train_size").agg(*aggs)


def fit_learning_scores(df: DataFrame, score_fn, label: str = "Left", key: str = "Customer_ID", fold_col: str = "fold", fractions=LEARNING_SIZES,
                        score: str = "proba") -> DataFrame:
    """The scores of a learning curve for any ``score_fn(train, rows)``, two calls a fold and size."""
    sizes = fold_sizes(df, fold_col)
    folds, out = sorted(sizes), None
    d = written(fold_positions(df, key, fold_col, folds), "learning-rows")
    for i, f in enumerate(folds):
        for n in train_sizes(sizes, fractions):
            sub = d.where((F.col("_pos")[i] > 0) & (F.col("_pos")[i] <= n)).drop("_pos")
            for part, rows in (("train", sub), ("validation", d.where(F.col(fold_col) == f).drop("_pos"))):
                s = score_fn(sub, rows).select(F.lit(part).alias("part"), F.lit(f).alias("fold"), F.lit(n).cast("long").alias("train_size"),
                                               F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("score"))
                out = s if out is None else out.unionByName(s)
    return out


def permutation_importance(model_fn, df: DataFrame, features, label: str = "Left", key: str = "Customer_ID",
                           repeats: int = 10, seed: int = 17) -> DataFrame:
    """V5: mean and sd of the accuracy drop when one column is permuted.

    One shuffle builds all permutations: the row at key position r takes its
    value from the row at position r in the order md5(seed:repeat:key), the
    same for every column of a repeat; one scoring pass scores them all.
    ``model_fn(df)`` must add ``prob``.
    """
    feats = F.array(*[F.col(c).cast("double") for c in features])
    hit = F.when((F.col("prob") > 0.5).cast("int") == F.col(label).cast("int"), 1.0).otherwise(0.0)
    base_acc = model_fn(df).agg(F.avg(hit)).scalar()
    # one order a repeat serves all columns: each row meets the row at its place in that order, with all its values
    reps = F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("_rep")
    own = global_rank(df.select(key, label, *features), [key], out="_ra").select("*", reps)
    other = df.select(F.col(key), feats.alias("_other")).select(key, "_other", reps).withColumn("_h", md5_hex(seed, "_rep", key))
    other = global_rank(other, ["_h"], group_cols=["_rep"], bucket=hash_bucket(F.col("_h"), 4), out="_ra").select("_rep", "_ra", "_other")
    j = own.join(other, ["_rep", "_ra"]).select("*", F.explode(F.array(*[F.lit(c) for c in features])).alias("_col"))
    for i, c in enumerate(features):
        j = j.withColumn(c, F.when(F.col("_col") == c, F.col("_other")[i]).otherwise(F.col(c).cast("double")))
    acc = model_fn(j.drop("_other", "_ra")).groupBy("_col", "_rep").agg(F.avg(hit).alias("acc"))
    drop = acc.select("_col", "_rep", (base_acc - F.col("acc")).alias("drop"))
    return drop.groupBy(F.col("_col").alias("feature")).agg(F.avg("drop").alias("importance_mean"),
                                                            F.stddev_pop("drop").alias("importance_std")) \
        .orderBy(F.col("importance_mean").asc())
