"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "churnlens") -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect.

    On a cluster the master, memory and shuffle sizes come from spark-submit;
    the values here only apply when nothing else set them.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder, as ``spark.checkpoint.dir`` names it.

    A cluster must name one, as its nodes share no local folder. Only a
    ``local`` master may leave it unset (tests): then a fresh folder under the
    system temp dir is made.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"master {master} needs spark.checkpoint.dir: a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="churnlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table, inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``churnlens`` importable in Python workers (once per context).

    Operators that run Python on executors (Arrow batches in pandas) call
    this. The zip is code, not data: it is built in the driver's own temp
    folder, and Spark's file server hands it to every executor, so it works
    whatever store the checkpoint folder is in.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    local = os.path.join(tempfile.mkdtemp(prefix="churnlens-code-"), "churnlens.zip")
    with zipfile.ZipFile(local, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(local)
    _SHIPPED.add(key)


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` to a fresh folder beside the checkpoints; its path."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: cuts the lineage, survives executor loss."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def inputs_key(spark: SparkSession, sf_dir: str) -> tuple:
    """What identifies the tables in a folder: names, lengths and times of the files below it (two levels), on any store."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(sf_dir)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []
    for f in fs.listStatus(at):
        for g in fs.listStatus(f.getPath()) if f.isDirectory() else [f]:
            seen.append((g.getPath().toString(), g.getLen(), g.getModificationTime()))
    return (sf_dir, *sorted(seen))


_ONCE: dict = {}


def once(spark: SparkSession, name: str, key, build):
    """What ``build()`` gives, kept for the session by name and key (paths of written tables, fitted models)."""
    k = (spark.sparkContext.applicationId, name, key)
    if k not in _ONCE:
        _ONCE[k] = build()
    return _ONCE[k]


def stored(spark: SparkSession, name: str, key, make) -> DataFrame:
    """The table that ``make()`` gives, made and written once per session, name and key."""
    return spark.read.parquet(once(spark, f"table {name}", key, lambda: write_table(make(), name)))
