"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import checkpoint_dir, ship_package

#: Rows of an Arrow batch. Documents are long; a batch of 10,000 (the default) could hold gigabytes.
BATCH_ROWS = 512


def ready(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small before Python runs on executors."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text, under fixed names: columns of the input cannot clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod(ids: pd.Series, mod: int) -> np.ndarray:
    """crc32 of the id as decimal text, modulo ``mod``; -1 where the id is null."""
    return np.array([-1 if pd.isna(i) else zlib.crc32(str(int(i)).encode()) % mod for i in ids], dtype=np.int64)


def crc_mod_sql(id_col: str, mod: int):
    """The same as a column; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def n_partitions(rows_or_bytes: float, per_task: float, least: int) -> int:
    """So many partitions that each has about ``per_task``; at least ``least``."""
    return max(int(least), int(-(-rows_or_bytes // per_task)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
