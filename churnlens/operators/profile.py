"""Profiling operators: statistics, counts, rates, box plots, correlation, reshape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, IntegerType, LongType, ShortType

from churnlens.functions.expressions import is_missing
from churnlens.operators.quantile import quantile_row


def melt(df: DataFrame, ids, values, var: str = "variable", val: str = "value") -> DataFrame:
    """Wide -> long; value columns are cast to double first."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    d = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return d.unpivot(ids, list(values), var, val)


def exact_mean(df: DataFrame, col: str, decimals: int | None = None):
    """Mean of a column, the same on any engine and partitioning.

    Whole-number columns, and columns whose values have at most ``decimals``
    places (2 for money in cents), are summed exactly as decimals and divided
    once. Without ``decimals`` a decimal column has its own scale, and a
    floating one is averaged and rounded to 6 places. Nulls do not count.
    """
    t, c = df.schema[col].dataType, F.col(col)
    if isinstance(t, (ByteType, ShortType, IntegerType, LongType)):
        decimals = 0
    elif decimals is None and isinstance(t, DecimalType):
        return F.sum(c.cast(DecimalType(38, t.scale))).cast("double") / F.count(c)
    if decimals is None:
        return F.round(F.avg(c.cast("double")), 6)
    s = 10 ** decimals
    return F.sum(F.round(c * s).cast("decimal(38,0)")).cast("double") / (F.count(c) * s)


def _long(df: DataFrame, cols, group_cols=()):
    return melt(df.select(*group_cols, *cols), list(group_cols), cols)


def describe_numeric(df: DataFrame, cols, decimals: dict | None = None) -> DataFrame:
    """A1: mean, median and sample sd per column (tidy: one row per column)."""
    decimals = decimals or {}
    means = df.agg(*[exact_mean(df, c, decimals.get(c)).alias(c) for c in cols])
    sds = df.agg(*[F.round(F.stddev_samp(c), 6).alias(c) for c in cols])
    med = quantile_row(_long(df, cols), "value", [0.5], ["median"], ["variable"])
    mean_l = means.unpivot([], list(cols), "variable", "mean")
    sd_l = sds.unpivot([], list(cols), "variable", "sd")
    return mean_l.join(med, "variable").join(sd_l, "variable").select("variable", "mean", "median", "sd")


def summary6(df: DataFrame, cols, decimals: dict | None = None) -> DataFrame:
    """A2: min, Q1, median, mean, Q3, max and missing count per column."""
    decimals = decimals or {}
    base = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                             exact_mean(df, c, decimals.get(c)).alias("mean"),
                             F.sum(F.when(is_missing(df, c), 1).otherwise(0)).cast("bigint").alias("n_missing"))
                    .alias(c) for c in cols])
    long = base.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("s"))
                                          for c in cols])).alias("r")).select("r.variable", "r.s.*")
    q = quantile_row(_long(df, cols), "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], ["variable"])
    return long.join(q, "variable", "left").select("variable", "min", "q1", "median", "mean", "q3", "max",
                                                   "n_missing")


def count_by(df: DataFrame, keys) -> DataFrame:
    """A3/A4: row count per key combination (bars: plain, stacked or dodged)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def rate_by(df: DataFrame, x, cls: str = "Left") -> DataFrame:
    """A5: share of each class within each value of ``x`` (position = "fill").

    The window runs over the aggregated counts (values x classes rows), not
    over the input rows.
    """
    xs = [x] if isinstance(x, str) else list(x)
    c = count_by(df, xs + [cls])
    w = Window.partitionBy(*xs)
    return c.select(*xs, cls, "n", (F.col("n") / F.sum("n").over(w)).alias("share"))


def class_distribution(df: DataFrame, label: str = "Left") -> DataFrame:
    """Normalised value counts of the label."""
    c = count_by(df, label)
    return c.select(label, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def pos_weight(df: DataFrame, label: str = "Left") -> DataFrame:
    """n0 / n1 (the boosted-tree ``scale_pos_weight``); null without a row of class 1."""
    y = F.col(label)
    r = df.agg(F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("n0"),
               F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("n1"))
    return r.select("n0", "n1", F.try_divide("n0", "n1").alias("pos_weight"))


def balanced_weights(df: DataFrame, label: str = "Left", key: str = "Customer_ID") -> DataFrame:
    """Per-row weight n / (2 n_class) for a binary label.

    The two class counts arrive as one scalar subquery, so no join is needed.
    """
    y = F.col(label)
    s = df.agg(F.struct(F.count(F.lit(1)).alias("n"),
                        F.sum(F.when(y == 0, 1).otherwise(0)).alias("n0"),
                        F.sum(F.when(y == 1, 1).otherwise(0)).alias("n1"))).scalar()
    n, n0, n1 = s.getField("n"), s.getField("n0"), s.getField("n1")
    w = F.when(y == 1, F.try_divide(n, n1 * 2)).otherwise(F.try_divide(n, n0 * 2))
    return df.select(key, label, w.alias("weight"))


def box_stats(df: DataFrame, col: str, by=(), k: float = 1.5) -> DataFrame:
    """A10: box-plot statistics per group.

    Whiskers are the most extreme values inside the 1.5 IQR fence; outliers
    are counted. The fence table has one row per group and is joined back.
    """
    by = [by] if isinstance(by, str) else list(by)
    q = quantile_row(df, col, [0.25, 0.5, 0.75], ["q1", "median", "q3"], by)
    iqr = F.col("q3") - F.col("q1")
    f = q.select(*by, "q1", "median", "q3",
                 F.round(F.col("q1") - k * iqr, 6).alias("lower_fence"),
                 F.round(F.col("q3") + k * iqr, 6).alias("upper_fence"))
    x = F.col(col).cast("double")
    data = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull())
    inside = (F.col("_x") >= F.col("lower_fence")) & (F.col("_x") <= F.col("upper_fence"))
    stats = [F.min(F.when(inside, F.col("_x"))).alias("lower_whisker"),
             F.max(F.when(inside, F.col("_x"))).alias("upper_whisker"),
             F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers"),
             F.count(F.lit(1)).alias("n")]
    fcols = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    if not by:
        s = f.select(F.struct(*fcols)).scalar()
        d = data.select("_x", *[s.getField(c).alias(c) for c in fcols])
        return d.groupBy(*fcols).agg(*stats)
    # fence table: one row per group; AQE broadcasts it when it is small
    j = data.join(f, [data[c].eqNullSafe(f[c]) for c in by])
    return j.groupBy(*[data[c].alias(c) for c in by], *fcols).agg(*stats)


def box_outliers(df: DataFrame, col: str, by=(), key: str = "Customer_ID", k: float = 1.5) -> DataFrame:
    """A10: the rows that a box plot draws as points: group, key and value of each row outside its group's fence."""
    by = [by] if isinstance(by, str) else list(by)
    f = box_stats(df, col, by, k).select(*[F.col(c).alias(f"_by_{c}") for c in by], "lower_fence", "upper_fence")
    d = df.select(*by, key, F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull())
    cond = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    j = d.join(f, cond) if by else d.select("*", *[f.select(c).scalar().alias(c) for c in ("lower_fence", "upper_fence")])
    return j.where((F.col(col) < F.col("lower_fence")) | (F.col(col) > F.col("upper_fence"))).select(*by, key, col)


def box_facets(df: DataFrame, cols, by: str = "Left") -> DataFrame:
    """A10 over U2: one box per (variable, class)."""
    long = melt(df, [by], cols)
    return box_stats(long, "value", ["variable", by])


def corr_matrix(df: DataFrame, cols, upper_only: bool = True) -> DataFrame:
    """Pearson correlations, one aggregation pass, tidy output."""
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)
             if (i < j if upper_only else i != j)]
    r = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
                 for a, b in pairs])
    long = r.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"{a}__{b}").alias("corr"))
        for a, b in pairs])).alias("s")).select("s.*")
    return long.select("var1", "var2", F.round("corr", 6).alias("corr"))


def fold_summary(df: DataFrame, keys=("model", "metric"), value: str = "value") -> DataFrame:
    """Mean and population sd over folds."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                 F.count(F.lit(1)).alias("n_folds"))
