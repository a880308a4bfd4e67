"""Global rank and running sum without a single-partition window.

A window with no partition keys moves every row into one task. Instead the
rows get a *bucket* that respects the sort order (hash prefix for hash order,
approximate-quantile bounds for value order). Per-bucket totals form a small
table (groups x buckets rows); a running sum over it gives each bucket its
offset, and a window partitioned by (group, bucket) finishes the job. A bucket
that one frequent leading value overfills is cut again by bounds of the next
order column, so that value is no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Rows a bucket should have about, and the most buckets that are made.
ROWS_PER_BUCKET, MAX_BUCKETS = 200_000, 10_000
_SKETCH_ACCURACY = 100_000


def _as_number(df: DataFrame, col: str) -> Column:
    """A double that is monotone in Spark's order of ``col``.

    Strings are ordered by their bytes: the six bytes after the prefix that
    all values share become a number (one small job finds the prefix).
    """
    if not isinstance(df.schema[col].dataType, StringType):
        return F.col(col).cast("double")
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    lo, hi = (lo or "").encode(), (hi or "").encode()
    same = next((i for i, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
    part = F.hex(F.substring(F.encode(F.col(col), "UTF-8"), same + 1, 6))
    return F.when(F.col(col).isNotNull(), F.conv(F.rpad(part, 12, "0"), 16, 10).cast("double"))


def value_bucket(df: DataFrame, col: str, n_buckets: int | None = None,
                 descending: bool = False, out: str = "_bk") -> tuple[DataFrame, int]:
    """Add bucket column ``out`` from approximate quantile bounds of ``col``; also the number of rows (0 if not counted).

    The bounds are one small job that counts the rows, too: unless given, the
    number of buckets follows the count. Only that bounded list of numbers
    reaches the driver. The bucket is a JVM-side binary search
    (``Bucketizer``). Any monotone bucketing gives an exact rank; the sketch
    only balances the buckets. Nulls and NaN have buckets of their own where
    Spark's order puts them: nulls lowest, NaN highest.
    """
    from pyspark.ml.feature import Bucketizer
    tmp = "_bx_" + out
    with_x = df.withColumn(tmp, _as_number(df, col))
    most = n_buckets or MAX_BUCKETS
    step = max(1, most // 1000) if n_buckets is None else 1
    probs = [i / most for i in range(step, most, step)]
    n, fine = with_x.agg(F.count(F.lit(1)), F.percentile_approx(F.when(~F.isnan(tmp), F.col(tmp)), probs, _SKETCH_ACCURACY)).first() \
        if probs else (0, [])
    if n_buckets is None:       # thin the bounds out to the buckets that the rows need
        need = min(len(probs) + 1, -(-n // ROWS_PER_BUCKET))
        fine = [fine[len(fine) * i // need] for i in range(1, need)] if fine else []
    fine = [float(v) for v in (fine or []) if v is not None and abs(v) != float("inf")]
    # a value that is several bounds fills buckets on its own: it gets one to itself
    bounds = sorted({*fine, *[math.nextafter(v, math.inf) for v in set(fine) if fine.count(v) > 1]})
    splits = [float("-inf"), *bounds, float("inf")]
    if bounds:
        b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out + "_d", handleInvalid="keep").transform(with_x)
    else:
        b = with_x.withColumn(out + "_d", F.lit(0.0))
    idx = F.when(F.col(tmp).isNull(), -1).when(F.isnan(tmp), len(splits)).otherwise(F.col(out + "_d").cast("int"))
    if descending:
        idx = F.lit(len(splits)) - idx
    return b.withColumn(out, idx).drop(tmp, out + "_d"), n


def _refined(b: DataFrame, first: str, second: str, descending: bool, limit: int) -> DataFrame:
    """``b`` with buckets that hold one value of ``first``, and over twice ``limit`` rows, cut by bounds of ``second``.

    Every such bucket is an interval [h, h + 1) of one number line, on which its
    rows lie in the order of ``second`` (nulls lowest, NaN highest); the bounds
    of all of them are one list, and a row's place among them one search.
    """
    from pyspark.ml.feature import Bucketizer
    heavy = b.groupBy("_bk").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("lo"), F.max(first).alias("hi")) \
        .where((F.col("n") > 2 * limit) & F.col("lo").eqNullSafe(F.col("hi"))).select("_bk", "n").collect()     # MAX_BUCKETS rows at most
    if not heavy:
        return b
    spark = b.sparkSession
    h = F.broadcast(spark.createDataFrame([(r["_bk"], float(i)) for i, r in enumerate(heavy)], f"_bk {b.schema['_bk'].dataType.simpleString()}, _h double"))
    x = b.join(h, "_bk", "left").withColumn("_x", _as_number(b, second))
    seen = F.col("_h").isNotNull() & F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") != float("inf"))
    ends = F.broadcast(x.where(seen).groupBy("_h").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    x = x.join(ends, "_h", "left")
    inside = F.coalesce(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) / 2 + 0.25
    place = F.when(F.col("_x").isNull(), 0.1).when(F.isnan("_x"), 0.9).otherwise(F.least(F.greatest(inside, F.lit(0.2)), F.lit(0.8)))
    x = x.withColumn("_z", F.coalesce(F.col("_h") + place, F.lit(-1.0)))
    need = -(-max(r["n"] for r in heavy) // limit)
    cuts = x.where("_h is not null").groupBy("_h").agg(F.percentile_approx("_z", [i / need for i in range(1, need)], _SKETCH_ACCURACY).alias("q")).collect()
    splits = sorted({float("-inf"), float("inf"), *[float(i) for i in range(len(heavy))], *[v for r in cuts for v in r["q"]]})
    sub = Bucketizer(splits=splits, inputCol="_z", outputCol="_sub", handleInvalid="keep").transform(x)
    at = F.col("_sub").cast("long")
    at = F.lit(len(splits)) - at if descending else at
    return sub.withColumn("_bk", F.col("_bk").cast("long") * (len(splits) + 1) + at).drop("_h", "_x", "_lo", "_hi", "_z", "_sub")


def _bucketed(df: DataFrame, order_cols, n_buckets: int | None, descending: bool, bucket: Column | None) -> DataFrame:
    """``df`` with ``_bk``: the given bucket, or value bounds of the first order column, cut further by the second."""
    if bucket is not None:
        return df.withColumn("_bk", bucket)
    if not isinstance(order_cols[0], str):
        raise ValueError("give `bucket` when ordering by an expression")
    b, n = value_bucket(df, order_cols[0], n_buckets, descending)
    if len(order_cols) < 2 or not isinstance(order_cols[1], str):
        return b
    limit = ROWS_PER_BUCKET if n_buckets is None else max(1, -(-(n or df.count()) // n_buckets))
    return _refined(b, order_cols[0], order_cols[1], descending, limit) if n_buckets or (n or 0) > 2 * limit else b


def _order_exprs(order_cols, descending):
    out = []
    for c in order_cols:
        if isinstance(c, Column):
            out.append(c)
        else:
            out.append(F.col(c).desc() if descending else F.col(c).asc())
    return out


def _with_offsets(b: DataFrame, group_cols, sums: dict[str, Column]) -> DataFrame:
    """Join each row to the running total of all earlier buckets in its group."""
    g = list(group_cols)
    totals = b.groupBy(*g, "_bk").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    w_run = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("_bk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*g) if g else Window.partitionBy()
    offs = totals.select(
        *[F.col(c).alias(f"_g_{c}") for c in g], F.col("_bk").alias("_g_bk"),
        *[F.coalesce(F.sum(f"_t_{n}").over(w_run), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(w_all).alias(f"_tot_{n}") for n in sums])
    cond = [b["_bk"] == offs["_g_bk"]] + [b[c].eqNullSafe(offs[f"_g_{c}"]) for c in g]
    j = b.join(offs, cond)
    return j.drop(*[f"_g_{c}" for c in g], "_g_bk")


def global_rank(df: DataFrame, order_cols, group_cols=(), descending: bool = False,
                bucket: Column | None = None, n_buckets: int | None = None,
                out: str = "rank", total: str | None = None) -> DataFrame:
    """1-based row number in ``order_cols`` order, within ``group_cols``.

    ``bucket`` must be monotone in the order (e.g. a hash prefix when ordering
    by that hash); by default buckets come from value bounds of the first
    order column. ``total`` optionally names a column with the group size.
    """
    cols = df.columns
    b = _bucketed(df, order_cols, n_buckets, descending, bucket)
    j = _with_offsets(b, group_cols, {"n": F.lit(1)})
    w = Window.partitionBy(*group_cols, "_bk").orderBy(*_order_exprs(order_cols, descending))
    sel = [F.col(c) for c in cols] + [(F.col("_off_n") + F.row_number().over(w)).cast("bigint").alias(out)]
    if total:
        sel.append(F.col("_tot_n").cast("bigint").alias(total))
    return j.select(*sel)


def global_cumsum(df: DataFrame, order_cols, sum_cols, group_cols=(), descending: bool = False,
                  bucket: Column | None = None, n_buckets: int | None = None,
                  prefix: str = "cum_", total_prefix: str | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in order, within groups.

    Rows with equal order keys are summed row by row in the order given, so
    pass a unique order (pre-aggregate ties first) when ties matter.
    """
    cols = df.columns
    b = _bucketed(df, order_cols, n_buckets, descending, bucket)
    sums = {c: F.col(c) for c in sum_cols}
    j = _with_offsets(b, group_cols, sums)
    w = (Window.partitionBy(*group_cols, "_bk").orderBy(*_order_exprs(order_cols, descending))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sel = [F.col(c) for c in cols]
    sel += [(F.col(f"_off_{c}") + F.sum(c).over(w)).alias(prefix + c) for c in sum_cols]
    if total_prefix:
        sel += [F.col(f"_tot_{c}").alias(total_prefix + c) for c in sum_cols]
    return j.select(*sel)
