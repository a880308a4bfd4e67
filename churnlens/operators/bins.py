"""Binning operators (B1-B7): the data behind bar charts and histograms.

Each bin rule follows the plotting library the reference used; the rule is
stated in each docstring. Range statistics come from one aggregation and are
applied as scalar subqueries, so every operator stays one lazy plan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.profile import rate_by
from churnlens.operators.quantile import quantiles


def _fmt(c):
    """Bin edge as text: whole numbers without a decimal point."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def cut_width(df: DataFrame, col: str, start: float, width: float, extra: float = 0.0,
              out: str = "bin") -> DataFrame:
    """B1: R ``cut(x, seq(start, max(x) + extra, by=width), right=FALSE)``.

    Bins are [a, b). ``seq`` stops at the last break <= max + extra, so any
    value at or beyond that break (or below ``start``) gets a null bin.
    Adds ``{out}_lo``, ``{out}_hi`` and the label ``{out}``.
    """
    mx = df.agg(F.max(F.col(col).cast("double"))).scalar()
    x = F.col(col).cast("double")
    n_breaks = F.floor((mx + extra - start) / width)          # index of the last break
    idx = F.floor((x - start) / width)
    ok = (x >= start) & (idx < n_breaks)
    lo = F.when(ok, (F.lit(start) + idx * width).cast("double"))
    hi = F.when(ok, (F.lit(start) + (idx + 1) * width).cast("double"))
    d = df.withColumn(out + "_lo", lo).withColumn(out + "_hi", hi)
    return d.withColumn(out, F.when(ok, F.concat(F.lit("["), _fmt(F.col(out + "_lo")), F.lit(","),
                                                   _fmt(F.col(out + "_hi")), F.lit(")"))))


def cut_n(df: DataFrame, col: str, n: int = 20, out: str = "bin") -> DataFrame:
    """B2: R ``cut(x, breaks=n)``: n equal bins over [min, max], right-closed.

    Inner edges are min + i (max - min) / n; the outer edges move out by
    (max - min) / 1000. Bin index = ceil((x - min) / w) - 1, clipped to 0..n-1.
    A constant column c has edges from c - |c| / 1000 to c + |c| / 1000, as in
    R; a column of zeros, which R refuses, has null bins.
    """
    st = df.agg(F.struct(F.min(F.col(col).cast("double")).alias("mn"),
                         F.max(F.col(col).cast("double")).alias("mx"))).scalar()
    mn, mx = st.getField("mn"), st.getField("mx")
    flat = mn == mx
    dx = F.when(flat, F.abs(mn)).otherwise(mx - mn)
    first = F.when(flat, mn - dx / 1000).otherwise(mn)
    w = F.when(flat, F.when(dx > 0, dx / 500 / n)).otherwise(dx / n)
    x = F.col(col).cast("double")
    idx = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.when(flat & (dx > 0), -(-n // 2) - 1).otherwise(F.ceil(F.try_divide(x - first, w)) - 1)))
    idx = F.when(w.isNotNull(), idx)
    lo = F.when(idx == 0, mn - dx / 1000).otherwise(first + idx * w)
    hi = F.when(idx == n - 1, mx + dx / 1000).otherwise(first + (idx + 1) * w)
    d = df.withColumn(out + "_idx", F.when(x.isNotNull(), idx.cast("int")))
    d = d.withColumn(out + "_lo", F.when(x.isNotNull(), F.round(lo, 6))) \
         .withColumn(out + "_hi", F.when(x.isNotNull(), F.round(hi, 6)))
    return d


def hist_width(df: DataFrame, col: str, width: float, by=()) -> DataFrame:
    """ggplot2 ``geom_histogram(binwidth=w)``: bins centred on multiples
    of w, right-closed: centre k w holds ((k - 1/2) w, (k + 1/2) w]."""
    by = [by] if isinstance(by, str) else list(by)
    x = F.col(col).cast("double")
    k = F.ceil((x - width / 2) / width).cast("bigint")
    d = df.where(x.isNotNull()).select(*by, k.alias("k"))
    c = d.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"))
    return c.select(*by, (F.col("k") * width).cast("double").alias("center"),
                    ((F.col("k") - 0.5) * width).alias("lo"), ((F.col("k") + 0.5) * width).alias("hi"), "n")


def hist_bins(df: DataFrame, col: str, bins: int = 30, by=()) -> DataFrame:
    """ggplot2 ``geom_histogram(bins=n)``: width = range / (n - 1), first
    bin centred on the minimum, right-closed; shared range over groups. A
    constant column has one bin, centred on its value."""
    by = [by] if isinstance(by, str) else list(by)
    st = df.agg(F.struct(F.min(F.col(col).cast("double")).alias("mn"),
                         F.max(F.col(col).cast("double")).alias("mx"))).scalar()
    mn, mx = st.getField("mn"), st.getField("mx")
    w = (mx - mn) / (bins - 1)
    x = F.col(col).cast("double")
    k = F.when(w == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((x - mn - w / 2) / w))).cast("int")
    d = df.where(x.isNotNull()).select(*by, k.alias("k"), mn.alias("_mn"), w.alias("_w"))
    c = d.groupBy(*by, "k", "_mn", "_w").agg(F.count(F.lit(1)).alias("n"))
    return c.select(*by, "k", F.round(F.col("_mn") + F.col("k") * F.col("_w"), 6).alias("center"), "n")


# Fixed values of R's pretty(): high.u.bias, u5.bias and its rounding eps.
_PRETTY_H = 1.5
_PRETTY_H5 = 0.5 + 1.5 * _PRETTY_H
_PRETTY_EPS = 1e-10


def pretty_breaks(stats, lo: str, up: str, ndiv: str):
    """R ``pretty(c(lo, up), ndiv)`` over a (one-row) stats DataFrame.

    Adds ``_start`` and ``_unit``: the breaks are _start + i _unit. Each step
    is its own projection so no sub-expression is repeated. A range of zero
    width takes its cell from the size of the value, as R does (the shrinking
    factor 0.75 is R's, with one division at least).
    """
    size = F.abs(F.col(lo))
    point = F.when(size == 0, 1.0).when(size > 10, 9 + size / 10).otherwise(size) * 0.75
    d = stats.withColumn("_cell", F.when(F.col(up) == F.col(lo), point).otherwise((F.col(up) - F.col(lo)) / F.col(ndiv)))
    d = d.withColumn("_base", F.pow(F.lit(10.0), F.floor(F.log10("_cell"))))
    cell, base = F.col("_cell"), F.col("_base")
    d = d.withColumn("_u2", F.when(2 * base - cell < _PRETTY_H * (cell - base), 2 * base).otherwise(base))
    u2 = F.col("_u2")
    d = d.withColumn("_u5", F.when((u2 == 2 * base) & (5 * base - cell < _PRETTY_H5 * (cell - u2)), 5 * base)
                     .otherwise(u2))
    u5 = F.col("_u5")
    d = d.withColumn("_unit", F.when((u5 == 5 * base) & (10 * base - cell < _PRETTY_H * (cell - u5)), 10 * base)
                     .otherwise(u5))
    unit = F.col("_unit")
    d = d.withColumn("_ns0", F.floor(F.col(lo) / unit + _PRETTY_EPS))
    ns0 = F.col("_ns0")
    d = d.withColumn("_start", F.when(ns0 * unit > F.col(lo) + _PRETTY_EPS * unit, ns0 - 1).otherwise(ns0) * unit)
    return d


def hist_sturges(df: DataFrame, col: str) -> DataFrame:
    """Base R ``hist(x, breaks=nclass.Sturges(x), probability=TRUE)``.

    Sturges suggests ceil(log2 n + 1) classes; ``pretty`` turns that into
    round breaks; bins are right-closed with the lowest edge included;
    density = count / (n * width).
    """
    x = F.col(col).cast("double")
    st = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n"))
    st = st.withColumn("_ndiv", F.ceil(F.log2("n") + 1))
    br = pretty_breaks(st, "mn", "mx", "_ndiv").select(F.struct("_start", "_unit", "n")).scalar()
    start, unit, n = br.getField("_start"), br.getField("_unit"), br.getField("n")
    idx = F.greatest(F.lit(0), F.ceil((x - start) / unit) - 1).cast("int")
    d = df.where(x.isNotNull()).select(idx.alias("k"), start.alias("_s"), unit.alias("_u"), n.alias("_n"))
    c = d.groupBy("k", "_s", "_u", "_n").agg(F.count(F.lit(1)).alias("n"))
    lo = F.col("_s") + F.col("k") * F.col("_u")
    return c.select("k", F.round(lo, 6).alias("lo"), F.round(lo + F.col("_u"), 6).alias("hi"), "n",
                    F.round(F.col("n") / (F.col("_n") * F.col("_u")), 12).alias("density"))


def bin_rate(binned: DataFrame, bin_cols, cls: str = "Left") -> DataFrame:
    """Class share per bin; the null bin is kept as its own group."""
    return rate_by(binned, bin_cols, cls)


def key_bins(df: DataFrame, col: str, probs, start: float = 0.0, width: float = 10000.0) -> DataFrame:
    """Which [a, b) bins hold the given quantiles, with rounded labels.

    Labels round half to even, as R's ``round`` does.
    """
    q = quantiles(df, col, probs).withColumnRenamed("value", col)
    mx = df.agg(F.max(F.col(col).cast("double"))).scalar()
    x = F.col(col)
    n_breaks = F.floor((mx - start) / width)
    idx = F.floor((x - start) / width)
    ok = (x >= start) & (idx < n_breaks)
    return q.select("p", F.col(col).alias("value"), F.bround(x, 0).alias("label"),
                    F.when(ok, (F.lit(start) + idx * width).cast("double")).alias("bin_lo"))


def sturges(n: int) -> int:
    return int(math.ceil(math.log2(n) + 1))
