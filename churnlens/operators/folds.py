"""Preparation that belongs inside a fold: scaling, resampling and class weights.

``FoldEstimator`` wraps any Spark classifier. Fitting it scales by the rows it
is given, oversamples or weights only these, and trains; the model scales with
what was learned and never resamples. In a ``CrossValidator`` each fold is thus
prepared from its own training rows. The reference's other order (prepare
first, cut the folds then, which lets synthetic rows and scales leak) is the
option ``before_cv``: prepare the table, and give the estimator nothing to do.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.prepare import ScalerModel, fit_scaler
from churnlens.operators.smote import oversample
from churnlens.session import written

RESAMPLE = ("none", "smote")


def class_weight(df: DataFrame, label: str) -> float:
    """n0 / n1, as the reference weights the positive class (1 without positives)."""
    r = df.agg(F.sum(1 - F.col(label).cast("int")).alias("n0"), F.sum(F.col(label).cast("int")).alias("n1")).first()
    return float(r["n0"]) / r["n1"] if r["n1"] else 1.0


def keyed_oversample(df: DataFrame, features, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Key, label and features of the rows and of their SMOTE rows; the synthetic row of draw i has key -(i + 1), whatever the plan."""
    from churnlens.operators.smote import smote
    syn = smote(df, features, label, key, k, seed)
    own = df.select(F.col(key).cast("long").alias(key), F.col(label).cast("int").alias(label), *[F.col(c).cast("double").alias(c) for c in features])
    return own.unionByName(syn.select((-(F.col("draw") + 1)).alias(key), label, *features))


def prepared(train: DataFrame, others: list[DataFrame], features, label: str = "Left", key: str = "Customer_ID", scale: bool = False, resample: str = "none",
             k: int = 5, seed: int = 42) -> tuple[DataFrame, list[DataFrame], ScalerModel | None]:
    """The training rows scaled by themselves and resampled, and other rows scaled in the same way."""
    if resample not in RESAMPLE:
        raise ValueError(f"resample must be one of {RESAMPLE}")
    scaler = fit_scaler(train, list(features)) if scale else None
    move = scaler.transform if scaler else (lambda d: d)
    train = move(train)
    if resample == "smote":
        train = written(oversample(written(train, "fold-rows"), features, label, key, k, seed), "fold-balanced")
    return train, [move(d) for d in others], scaler


class FoldEstimator(Estimator):
    """A classifier that scales, resamples and weights inside its own fit.

    ``base``: any classifier of ``pyspark.ml`` (its features and label columns are
    set here). ``scale``: by mean and population sd of the rows given.
    ``resample``: ``none`` or ``smote``. ``weight``: None, a number for the
    positive class, or ``"train"`` for n0 / n1 of the rows given (before they are
    resampled); the base must have a ``weightCol``.
    """

    def __init__(self, base, features, label: str = "Left", key: str = "Customer_ID", scale: bool = False, resample: str = "none", weight=None, k: int = 5, seed: int = 42):
        super().__init__()
        self.base, self.features, self.label, self.key = base, list(features), label, key
        self.scale, self.resample, self.weight, self.k, self.seed = scale, resample, weight, k, seed

    def copy(self, extra=None):
        that = super().copy(extra)
        that.base = self.base.copy(extra)
        return that

    def _fit(self, dataset: DataFrame) -> FoldModel:
        weight = class_weight(dataset, self.label) if self.weight == "train" else self.weight
        rows, _, scaler = prepared(dataset, [], self.features, self.label, self.key, self.scale, self.resample, self.k, self.seed)
        d = rows.select(F.col(self.label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in self.features])
        base = self.base.copy({self.base.labelCol: "label", self.base.featuresCol: "features"})
        if weight is not None:
            d = d.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(1.0))
            base = base.copy({base.weightCol: "weight"})
        return FoldModel(base.fit(VectorAssembler(inputCols=self.features, outputCol="features").transform(d)), self.features, scaler)


class FoldModel(Model):
    """The base model behind the scaler of its training rows; the dataset keeps its own columns."""

    def __init__(self, model, features, scaler: ScalerModel | None):
        super().__init__()
        self.model, self.features, self.scaler = model, list(features), scaler

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = [F.col(c).cast("double") for c in self.features]
        if self.scaler:
            x = [F.round((c - F.lit(self.scaler.stats[n][0])) / F.lit(self.scaler.stats[n][1]), 9) for c, n in zip(x, self.features)]
        names, out = [f"_x{i}" for i in range(len(x))], self.model.getFeaturesCol()
        d = dataset.select("*", *[c.alias(n) for c, n in zip(x, names)])
        return self.model.transform(VectorAssembler(inputCols=names, outputCol=out).transform(d)).drop(out, *names)
