"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

__all__ = [
    "is_missing", "any_missing", "encode_binary", "label_code", "md5_hex",
    "md5_uniform", "safe_div", "hash_bucket",
]

# Fixed value: 2**32, scale of the first 8 hex digits of an md5.
_TWO32 = 4294967296.0


def is_missing(df: DataFrame, name: str) -> Column:
    """Missing = null, or NaN for float columns (R counts NaN as missing)."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def any_missing(df: DataFrame, cols=None) -> Column:
    cols = list(cols or df.columns)
    out = is_missing(df, cols[0])
    for c in cols[1:]:
        out = out | is_missing(df, c)
    return out


def encode_binary(col: str, positive: str = "Male") -> Column:
    """``positive`` -> 1, any other text -> 0, null stays null."""
    c = F.col(col)
    return F.when(c.isNull(), F.lit(None).cast("int")).when(c == positive, 1).otherwise(0).cast("int")


def label_code(col: str, labels: dict) -> Column:
    """Map codes to labels; codes outside the levels become null (R factor)."""
    c = F.col(col)
    expr = None
    for k, v in labels.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def md5_hex(seed, *cols) -> Column:
    """md5 of ``seed:col1:col2...``; the same text hash exists in DuckDB."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def md5_uniform(seed, *cols) -> Column:
    """Uniform [0, 1) from the first 8 hex digits of :func:`md5_hex`."""
    h = md5_hex(seed, *cols)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(_TWO32)


def hash_bucket(hex_col: Column, digits: int = 2) -> Column:
    """Order-respecting bucket of a hex string: its first ``digits`` digits."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null on a zero divisor (ANSI mode would throw)."""
    return F.try_divide(num, den)

