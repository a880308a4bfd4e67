"""Sources and sinks: CSV scan and write, model save/load, schema description."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("Customer_ID", T.LongType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.DoubleType()),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("Score", T.DoubleType()),
    T.StructField("Salary", T.DoubleType()),
    T.StructField("Balance", T.DoubleType()),
    T.StructField("Products_in_Use", T.IntegerType()),
    T.StructField("Left", T.IntegerType()),
])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = RAW_SCHEMA,
             blank_is_missing: bool = True) -> DataFrame:
    """Header CSV -> DataFrame with R's missing-value rules.

    ``NA`` and blank numeric fields are null. A blank text field cannot be told
    apart from ``NA`` by the reader; by default it is missing too. With
    ``blank_is_missing=False`` text columns are read without ``nullValue`` and
    mapped: blank -> "" and ``NA`` -> null.
    """
    r = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is None:
        r = r.option("inferSchema", True)
    else:
        r = r.schema(schema)
    if blank_is_missing or schema is None:
        return r.option("nullValue", "NA").csv(path)
    text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    loose = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = spark.read.option("header", True).schema(loose).option("emptyValue", "").csv(path)
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if f.name in text:
            out.append(F.when(c == "NA", F.lit(None)).otherwise(F.coalesce(c, F.lit(""))).alias(f.name))
        else:
            out.append(F.when((c == "NA") | (F.trim(c) == ""), F.lit(None))
                       .otherwise(c).cast(f.dataType).alias(f.name))
    return df.select(*out)


def _next_version(spark: SparkSession, path: str) -> str:
    """``path_N`` with the next N, listed by the file system that the path names (HDFS and object stores, too)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for f in fs.globStatus(at.suffix("_*")) or []:
        m = re.fullmatch(re.escape(at.getName()) + r"_(\d+)", f.getPath().getName())
        if m:
            n = max(n, int(m.group(1)))
    return f"{path.rstrip('/')}_{n + 1}"


def write_csv(df: DataFrame, path: str, versioned: bool = False) -> str:
    """Header CSV, no quoting, nulls as ``NA``, overwrite; Spark creates the directory.

    Output is a directory of part files written in parallel (no coalesce).
    ``versioned=True`` writes ``path_N`` with the next free N instead.
    """
    target = _next_version(df.sparkSession, path) if versioned else path
    # the CSV writer quotes a field that holds the separator: so each line is one field, with a separator no text has
    line = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for c in df.columns])
    (df.select(line.alias(",".join(df.columns))).write.mode("overwrite").option("header", True).option("sep", "\u0001")
       .option("quote", "\u0000").option("emptyValue", "").csv(target))
    return target


def save_model(model, path: str) -> str:
    """S3: persist a fitted pyspark.ml model (replaces a pickle)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """S3: load any model saved by :func:`save_model`."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.util import DefaultParamsReader
    meta = DefaultParamsReader.loadMetadata(path, __import__("pyspark").SparkContext.getOrCreate())
    cls = meta["class"].replace("org.apache.spark", "pyspark")
    if cls == "pyspark.ml.PipelineModel":
        return PipelineModel.load(path)
    module, name = cls.rsplit(".", 1)
    mod = __import__(module, fromlist=[name])
    return getattr(mod, name).load(path)


def describe_schema(df: DataFrame, n: int = 3) -> DataFrame:
    """One row per column: name, type and the first ``n`` values as text."""
    spark = df.sparkSession
    cols = df.columns
    sample = df.limit(n).select(*[F.col(c).cast("string").alias(c) for c in cols])
    agg = sample.agg(*[F.collect_list(F.coalesce(F.col(c), F.lit("NA"))).alias(c) for c in cols])
    types = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)],
                                  "pos int, column string, type string")
    stack = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.concat_ws(" ", F.col(c)).alias("sample")) for c in cols
    ])).alias("s")).select("s.*")
    return types.join(stack, "column").orderBy("pos").select("column", "type", "sample")


def tag_and_append(frames, tag: str = "Source", start: int = 1) -> DataFrame:
    """Tag each branch with its number and append by column name."""
    out = None
    for i, df in enumerate(frames, start=start):
        t = df.withColumn(tag, F.lit(i).cast("int"))
        out = t if out is None else out.unionByName(t)
    return out
