"""Preparation for modelling (X1-X4): split, folds, scaler, derived features.

Random choices are orders by ``md5(seed:key)``: reproducible, independent of
partitioning, and the same hash exists in SQL engines. Ranks within a class
use the bucketed global rank (R1), so a large class never lands in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.expressions import hash_bucket, md5_hex, safe_div
from churnlens.operators.profile import exact_mean
from churnlens.operators.rank import global_rank

_MAX_CLASSES = 1000
_HASH_DIGITS = 4            # 65,536 order-respecting buckets per class


def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Largest-remainder allocation of ``n_draws`` over classes (exact integers).

    Ties in the remainder go to the smaller class value, null first.
    """
    n = sum(counts.values())
    base = {c: (k * n_draws) // n for c, k in counts.items()}
    rem = {c: (k * n_draws) % n for c, k in counts.items()}
    left = n_draws - sum(base.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c is not None, 0 if c is None else c))[:left]:
        base[c] += 1
    return base


def split_quotas(counts: dict, test: float = 0.2) -> dict:
    """Test rows per class: n_test = ceil(test * n); train quotas by largest
    remainder, the test quota is the rest of each class."""
    n = sum(counts.values())
    n_test = math.ceil(test * n)
    train = approximate_mode(counts, n - n_test)
    return {c: counts[c] - train[c] for c in counts}


def _class_counts(df: DataFrame, label: str) -> dict:
    rows = df.groupBy(label).count().limit(_MAX_CLASSES + 1).collect()      # one row per class
    if len(rows) > _MAX_CLASSES:
        raise ValueError("label has too many classes for a stratified split")
    return {r[0]: r[1] for r in rows}


def stratified_split(df: DataFrame, key: str = "Customer_ID", label: str = "Left", test: float = 0.2,
                     seed: int = 17, stratify: bool = True, out: str = "is_test") -> DataFrame:
    """Exact per-class test quotas; rows chosen by hash order within class.

    Rows without a label are a class of their own.
    """
    d = df.withColumn("_h", md5_hex(seed, key))
    if stratify:
        q = split_quotas(_class_counts(df, label), test)
        r = global_rank(d, ["_h"], group_cols=[label], bucket=hash_bucket(F.col("_h"), _HASH_DIGITS), out="_r")
        lim = None
        for c, k in q.items():
            own = F.col(label).eqNullSafe(F.lit(c))
            lim = F.when(own, F.lit(k)) if lim is None else lim.when(own, F.lit(k))
        flag = F.col("_r") <= lim
    else:
        n = df.count()
        r = global_rank(d, ["_h"], bucket=hash_bucket(F.col("_h"), _HASH_DIGITS), out="_r")
        flag = F.col("_r") <= math.ceil(test * n)
    return r.withColumn(out, flag.cast("int")).drop("_h", "_r")


def stratified_folds(df: DataFrame, key: str = "Customer_ID", label: str = "Left", k: int = 5,
                     seed: int = 17, shuffle: bool = True, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1 per row, stratified by class.

    shuffle: rank by hash within class, fold = rank mod k (round robin).
    no shuffle: rank by key, folds are k contiguous blocks of each class.
    """
    if shuffle:
        d = df.withColumn("_h", md5_hex(seed, key))
        r = global_rank(d, ["_h"], group_cols=[label], bucket=hash_bucket(F.col("_h"), _HASH_DIGITS),
                        out="_r").drop("_h")
        f = (F.col("_r") - 1) % k
    else:
        r = global_rank(df, [key], group_cols=[label], out="_r", total="_nc")
        f = F.floor((F.col("_r") - 1) * k / F.col("_nc"))
    return r.withColumn(out, f.cast("int")).drop("_r", "_nc")


class ScalerModel:
    """Fitted population-sd scaler: (x - mean) / sd, sd = 0 -> 1, 9 places."""

    def __init__(self, stats: dict):
        self.stats = stats          # col -> (mean, sd)

    def transform(self, df: DataFrame, suffix: str = "", places: int = 9) -> DataFrame:
        out = df
        for c, (m, s) in self.stats.items():
            out = out.withColumn(c + suffix, F.round((F.col(c) - F.lit(m)) / F.lit(s), places))
        return out


def fit_scaler(df: DataFrame, cols, decimals: dict | None = None) -> ScalerModel:
    """Fit mean and population sd (2 numbers per column reach the driver)."""
    decimals = decimals or {}
    row = df.agg(*[exact_mean(df, c, decimals.get(c)).alias("m_" + c) for c in cols],
                 *[F.stddev_pop(F.col(c).cast("double")).alias("s_" + c) for c in cols]).first()
    stats = {}
    for c in cols:
        s = row["s_" + c]
        stats[c] = (float(row["m_" + c]), float(s) if s else 1.0)
    return ScalerModel(stats)


def engineer_features(df: DataFrame, on_zero: str = "null") -> DataFrame:
    """The 11 derived columns; divisions by zero give null (``on_zero``:
    "null" keeps the row, "drop" removes it, "error" raises)."""
    a, t, s, b, p = (F.col(c) for c in ("Age", "Tenure", "Salary", "Balance", "Products_in_Use"))
    div = (lambda n, d: n / d) if on_zero == "error" else safe_div
    out = df.select(
        "*",
        (a * t).alias("Age_Tenure"),
        div(s, a.cast("double")).alias("Salary_per_Age"),
        div(b, a.cast("double")).alias("Balance_per_Age"),
        div(s, (t + 1).cast("double")).alias("Salary_per_Tenure"),
        div(b, s).alias("Balance_Salary_Ratio"),
        div(s, (p + 1).cast("double")).alias("Salary_per_Product"),
        F.round(F.log1p(s), 9).alias("Log_Salary"),
        F.round(F.log1p(b), 9).alias("Log_Balance"),
        (s * s).alias("Salary_squared"),
        (a * a).alias("Age_squared"),
        (t * t).alias("Tenure_squared"))
    if on_zero == "drop":
        new = ["Salary_per_Age", "Balance_per_Age", "Salary_per_Tenure", "Balance_Salary_Ratio",
               "Salary_per_Product"]
        cond = F.lit(True)
        for c in new:
            cond = cond & F.col(c).isNotNull()
        out = out.where(cond)
    return out


ENGINEERED = ["Age_Tenure", "Salary_per_Age", "Balance_per_Age", "Salary_per_Tenure", "Balance_Salary_Ratio",
              "Salary_per_Product", "Log_Salary", "Log_Balance", "Salary_squared", "Age_squared",
              "Tenure_squared"]
