"""Exact quantiles (R type 7 / linear interpolation) as a distributed job.

Spark's exact ``percentile`` keeps one value->count map per group and merges
it in one task, which does not scale for a global quantile. Here values are
first counted (hot values collapse map-side), then a bucketed running count
(R1) gives every distinct value its rank range, and each value emits a row
only if it holds one of the two order statistics a probability needs.
``approx=True`` uses ``percentile_approx`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.rank import global_cumsum


def quantiles(df: DataFrame, col: str, probs, group_cols=(), approx: bool = False,
              accuracy: int = 10000, name: str = "value") -> DataFrame:
    """(group..., p, value) with value rounded to 6 places.

    For n values and probability p, h = (n - 1) p and the result is
    x[floor h] + (h - floor h) (x[ceil h] - x[floor h]) over the sorted values.
    Nulls and NaN are ignored.
    """
    g = list(group_cols)
    x = F.col(col).cast("double")
    vals = df.select(*g, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    probs = [float(p) for p in probs]
    if approx:
        a = vals.groupBy(*g).agg(F.percentile_approx("_x", probs, accuracy).alias("_q"))
        return a.select(*g, F.posexplode("_q").alias("_i", name)) \
            .select(*g, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("p"),
                    F.round(name, 6).alias(name))
    counts = vals.groupBy(*g, "_x").agg(F.count(F.lit(1)).alias("_n"))
    cum = global_cumsum(counts, ["_x"], ["_n"], group_cols=g, total_prefix="tot_")
    parr = F.array(*[F.lit(p) for p in probs])
    lo = F.col("cum__n") - F.col("_n")          # first 0-based rank held by this value
    hi = F.col("cum__n") - 1                    # last 0-based rank held by this value

    def target(p):
        h = (F.col("tot__n") - 1) * p
        return F.struct(p.alias("p"), h.alias("h"), F.floor(h).alias("r_lo"), F.ceil(h).alias("r_hi"))

    holds = lambda r: (r >= F.col("_lo_r")) & (r <= F.col("_hi_r"))
    hits = (cum.select(*g, "_x", lo.alias("_lo_r"), hi.alias("_hi_r"), F.transform(parr, target).alias("_t"))
            .select(*g, "_x", "_lo_r", "_hi_r",
                    F.filter("_t", lambda t: holds(t["r_lo"]) | holds(t["r_hi"])).alias("_t")))
    ex = hits.where(F.size("_t") > 0).select(*g, "_x", "_lo_r", "_hi_r", F.explode("_t").alias("t"))
    agg = ex.groupBy(*g, F.col("t.p").alias("p")).agg(
        F.first("t.h").alias("_h"),
        F.max(F.when(holds(F.col("t.r_lo")), F.col("_x"))).alias("_lo"),
        F.max(F.when(holds(F.col("t.r_hi")), F.col("_x"))).alias("_hi"))
    val = F.col("_lo") + (F.col("_h") - F.floor("_h")) * (F.col("_hi") - F.col("_lo"))
    return agg.select(*g, "p", F.round(val, 6).alias(name))


def quantile_row(df: DataFrame, col: str, probs, names, group_cols=(), approx: bool = False) -> DataFrame:
    """Quantiles pivoted to one row per group: columns ``names`` in ``probs`` order."""
    q = quantiles(df, col, probs, group_cols, approx=approx)
    g = list(group_cols)
    return q.groupBy(*g).agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n)
                               for p, n in zip(probs, names)])
