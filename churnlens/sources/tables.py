"""Parquet table access for the driver's test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; selecting ``columns`` prunes the scan."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df
