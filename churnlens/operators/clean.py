"""Cleaning operators (P1-P17, A12-A16) and the full cleaning chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.expressions import any_missing, encode_binary
from churnlens.operators.quantile import quantile_row
from churnlens.operators.rank import global_rank

# Valid credit-score range and the IQR fence multiplier.
SCORE_LO, SCORE_HI = 350, 850
FENCE_K = 1.5
# Copies per task when a duplicate group is expanded back into rows.
_EXPAND_CHUNK = 1 << 20


def encode_gender(df: DataFrame, col: str = "Gender", positive: str = "Male") -> DataFrame:
    """``Male`` -> 1, other text -> 0, null stays null (then dropped)."""
    return df.withColumn(col, encode_binary(col, positive))


def missing_report(df: DataFrame) -> DataFrame:
    """Rows with at least one missing value, total rows and percentage."""
    m = F.sum(F.when(any_missing(df), 1).otherwise(0)).cast("bigint")
    r = df.agg(m.alias("missing_rows"), F.count(F.lit(1)).alias("total_rows"))
    pct = F.col("missing_rows") * 100 / F.col("total_rows")
    return r.select("missing_rows", "total_rows", pct.alias("missing_pct"),
                    F.bround(pct, 2).alias("missing_pct_r2"))


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) anywhere."""
    return df.where(~any_missing(df))


def _group_all(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n_copies"))


def dup_count(df: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each identical group."""
    return _group_all(df).agg(F.sum(F.col("n_copies") - 1).cast("bigint").alias("n_duplicates"))


def dup_groups(df: DataFrame) -> DataFrame:
    """Identical groups that occur more than once, with their count."""
    return _group_all(df).where(F.col("n_copies") > 1).withColumnRenamed("n_copies", "count")


def expand_counts(df: DataFrame, count_col: str, first: int = 1, chunk: int = _EXPAND_CHUNK) -> DataFrame:
    """Turn a count back into rows ``first..count``, in chunks of ``chunk``.

    Groups with a count below ``first`` give no row. A group holding a third of the table would otherwise explode inside one
    task; chunk rows are spread by a repartition before the second explode.
    """
    c = F.col(count_col)
    n_chunks = F.ceil((c - first + 1) / F.lit(chunk)).cast("int")
    ch = df.where(c >= first).withColumn("_ch", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    ch = ch.repartition("_ch", *[x for x in df.columns if x != count_col])
    lo = F.lit(first) + F.col("_ch") * chunk
    hi = F.least(c, lo + chunk - 1)
    return ch.withColumn("_i", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint")))).drop("_ch")


def dup_rows(df: DataFrame) -> DataFrame:
    """The extra copies (copy 2..n of each identical group)."""
    g = dup_groups(df)
    return expand_counts(g, "count", first=2).drop("count", "_i")


def dedup(df: DataFrame) -> DataFrame:
    """Keep one row of each identical group (map-side partial dedup)."""
    return df.dropDuplicates()


def out_of_range(df: DataFrame, col: str, lo=SCORE_LO, hi=SCORE_HI) -> DataFrame:
    """P10: rows whose value lies outside [lo, hi]."""
    return df.where((F.col(col) < lo) | (F.col(col) > hi))


def out_of_range_count(df: DataFrame, col: str, lo=SCORE_LO, hi=SCORE_HI) -> DataFrame:
    return out_of_range(df, col, lo, hi).agg(F.count(F.lit(1)).alias("n_out_of_range"))


def out_of_range_positions(df: DataFrame, col: str, key: str, lo=SCORE_LO, hi=SCORE_HI) -> DataFrame:
    """1-based position (rank by ``key``) and value of out-of-range rows."""
    r = global_rank(df.select(key, col), [key], out="position")
    return out_of_range(r, col, lo, hi).select("position", key, col)


def keep_range(df: DataFrame, col: str, lo=SCORE_LO, hi=SCORE_HI) -> DataFrame:
    """Keep lo <= value <= hi."""
    return df.where(F.col(col).between(lo, hi))


def iqr_fence(df: DataFrame, col: str, k: float = FENCE_K, group_cols=(), approx: bool = False) -> DataFrame:
    """Q1, Q3, IQR and the fence [Q1 - k IQR, Q3 + k IQR] (6 places)."""
    q = quantile_row(df, col, [0.25, 0.75], ["q1", "q3"], group_cols, approx=approx)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*group_cols, "q1", "q3", iqr.alias("iqr"),
                    F.round(F.col("q1") - k * iqr, 6).alias("lower"),
                    F.round(F.col("q3") + k * iqr, 6).alias("upper"))


def _fence_scalar(df: DataFrame, col: str, k: float):
    f = iqr_fence(df, col, k)
    return f.select(F.struct("lower", "upper")).scalar()


def iqr_outliers(df: DataFrame, col: str, k: float = FENCE_K) -> DataFrame:
    """Rows outside the fence (the values the reference prints)."""
    s = _fence_scalar(df, col, k)
    x = F.col(col)
    return df.where((x < s.getField("lower")) | (x > s.getField("upper")))


def drop_iqr_outliers(df: DataFrame, col: str, k: float = FENCE_K) -> DataFrame:
    """Keep rows inside the fence (bounds inclusive)."""
    s = _fence_scalar(df, col, k)
    x = F.col(col)
    return df.where((x >= s.getField("lower")) & (x <= s.getField("upper")))


def fence_report(df: DataFrame, col: str, k: float = FENCE_K) -> DataFrame:
    """P13 report: fence plus the number of rows outside it (one row)."""
    f = iqr_fence(df, col, k)
    s = f.select(F.struct("lower", "upper")).scalar()
    x = F.col(col)
    n_out = df.agg(F.sum(F.when((x < s.getField("lower")) | (x > s.getField("upper")), 1).otherwise(0))
                   .cast("bigint")).scalar()
    return f.withColumn("n_outliers", F.coalesce(n_out, F.lit(0).cast("bigint")))


def share_report(df: DataFrame, flag, labels=("Outliers", "Regular Values")) -> DataFrame:
    """Two-row count and percentage table (the data behind the pies)."""
    hit = F.sum(F.when(flag, 1).otherwise(0)).cast("bigint")
    t = df.agg(hit.alias("a"), F.count(F.lit(1)).alias("t"))
    rows = t.select(F.explode(F.array(
        F.struct(F.lit(labels[0]).alias("category"), F.col("a").alias("n"), F.col("t").alias("total")),
        F.struct(F.lit(labels[1]).alias("category"), (F.col("t") - F.col("a")).alias("n"),
                 F.col("t").alias("total")))).alias("s")).select("s.*")
    return rows.select("category", "n", (F.col("n") * 100 / F.col("total")).alias("pct"))


def clean_table(raw: DataFrame, score_col: str = "Score", salary_col: str = "Salary") -> DataFrame:
    """Section 3.1 chain: encode -> drop missing -> dedup -> score range -> salary fence.

    Order matters: duplicates are found after tagging, the fence after the
    score filter. One shuffle for the dedup, one small job for the fence.
    """
    d = encode_gender(raw)
    d = drop_missing(d)
    d = dedup(d)
    d = keep_range(d, score_col)
    return drop_iqr_outliers(d, salary_col)


def below(df: DataFrame, col: str, limit: float) -> DataFrame:
    """Rows whose value is less than ``limit``; nulls and NaN are not."""
    return df.where((F.col(col) < limit) & ~F.isnan(F.col(col).cast("double")))


def below_sql(col: str, limit: float) -> str:
    """The same filter as SQL text."""
    return f"{col} < {limit} AND NOT isnan(CAST({col} AS DOUBLE))"


# The names under which a churn label is looked for, in order.
TARGET_NAMES = ("Left", "Churn", "Attrition", "Exited", "Target")


def resolve_target(df: DataFrame, candidates=TARGET_NAMES) -> str:
    """The first candidate that ``df`` has as a column; an error without any."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(candidates)} is a column")
