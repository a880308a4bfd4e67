"""Incremental ingest of branch extracts.

Row-local cleaning rules (S1 read rules, P1 tag, P4 encode, P9 missing,
P12 score range) apply to each micro-batch unchanged. Steps that need the
whole table (A15 duplicates, P13/P14 fence) stay batch operators over the
accumulated output, as in the batch chain.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators.clean import drop_missing, encode_gender, keep_range
from churnlens.session import scratch_path
from churnlens.sources.io import RAW_SCHEMA


def clean_stream(spark: SparkSession, input_dir: str, source: int, schema=RAW_SCHEMA) -> DataFrame:
    """A streaming DataFrame of cleaned rows from CSV files in ``input_dir``."""
    s = (spark.readStream.schema(schema).option("header", True).option("nullValue", "NA").csv(input_dir)
         .withColumn("Source", F.lit(source).cast("int")))
    return keep_range(drop_missing(encode_gender(s)), "Score")


def write_stream(df: DataFrame, out_dir: str, checkpoint: str | None = None, available_now: bool = True):
    """Append micro-batches to Parquet; the checkpoint lives in the shared folder."""
    ckpt = checkpoint or scratch_path(df.sparkSession, f"stream-ckpt-{uuid.uuid4().hex}")
    w = df.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
