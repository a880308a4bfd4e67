"""The labelled documents that the classifiers learn from: all of them, or a bounded sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import crc_mod_sql, id_text


def picked(docs: DataFrame, labels: DataFrame, label: str, per_label: int, mod: int, held_out: int, id_col: str = "doc_id") -> tuple[dict[int, int], dict[int, int]]:
    """Label by id of at most ``per_label`` documents of each label, by a hash of their id, and the number of all labelled ones.

    Only rows whose crc32 of the id modulo ``mod`` is not ``held_out`` count.
    Null ids and null labels do not; an id with several labels has the largest.
    Labels other than 0 and 1 are an error.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    lab = lab.where(crc_mod_sql("doc_id", mod) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    lab = lab.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    counts = {int(r["y"]): int(r["count"]) for r in lab.groupBy("y").count().limit(3).collect()}
    if not set(counts) <= {0, 1}:
        raise ValueError(f"{label} must be 0 or 1, not {sorted(set(counts) - {0, 1})}")
    rows = [r for y in counts for r in lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()]
    return {r["doc_id"]: r["y"] for r in rows}, counts


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, id_col: str = "doc_id", text_col: str = "text",
             carry: str | None = None) -> tuple[DataFrame, dict[int, int]]:
    """All labelled documents that may be learned from (``doc_id``, ``y``, ``text``, ``carry``), and their number by label.

    Ids, labels and texts count as in :func:`picked` and :func:`sample`.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    lab = lab.where(crc_mod_sql("doc_id", mod) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      (F.col(carry) if carry else F.lit(None)).cast("string").alias("carry"))
    own = own.where(F.col("doc_id").isNotNull() & (crc_mod_sql("doc_id", mod) != held_out)).join(lab, "doc_id")
    rows = own.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("text", "carry")).alias("x")).select("doc_id", "y", "x.*")
    seen = lab.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    counts = {int(r["y"]): int(r["count"]) for r in seen.groupBy("y").count().limit(3).collect()}
    if not set(counts) <= {0, 1}:
        raise ValueError(f"{label} must be 0 or 1, not {sorted(set(counts) - {0, 1})}")
    return rows, counts


def order_of(ids: pd.Series) -> pd.Series:
    """The key by which a sample is ordered: a hash of the id."""
    return ids.map(lambda i: (int(i) * 2654435761) % 2**32)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, mod: int, held_out: int,
           id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> tuple[pd.DataFrame, dict[int, int]]:
    """The documents of :func:`picked`, and the number of all labelled ones.

    An id with several texts has the smallest. The bound holds for the rows
    that reach the driver: columns ``doc_id``, ``y``, ``text`` and ``carry``.
    """
    y, counts = picked(docs, labels, label, per_label, mod, held_out, id_col)
    cols = id_text(docs, id_col, text_col) if carry is None else docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(carry).cast("string").alias("carry"))
    take = [F.min(F.struct("text", *(["carry"] if carry else []))).alias("x")]
    rows = cols.where(F.col("doc_id").isin(list(y))).groupBy("doc_id").agg(*take).select("doc_id", "x.*").toPandas()
    rows["y"] = [y[i] for i in rows["doc_id"]]
    return rows.iloc[order_of(rows["doc_id"]).argsort(kind="stable").to_numpy()].reset_index(drop=True), counts
