"""Approximate nearest neighbours by cosine: cross-polytope hashing with several probes.

Each table turns unit vectors by a pseudo-random rotation (three rounds of
random signs and a fast Hadamard transform) and files a vector under the
signed axis nearest to it. A query looks into the buckets of its nearest few
signed axes in every table. Buckets are read in tiles of bounded size; each
tile ranks its candidates exactly, in double precision on the original
vectors, and hands on the few best per query.

Equal vectors are filed once, with the smallest ids of their group: no more
can be among the best of any query. A query that found fewer candidates than
asked for (a tiny table) is compared with all rows, in the same tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import n_partitions, ready, shuffle_partitions, written

TABLES, PROBES = 10, 8
#: Candidates and queries of a tile.
TILE, QUERY_TILE = 8192, 1024


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation number ``table`` of the rows of x, padded with zeros to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    g = np.random.default_rng([7, table, d])
    for _ in range(3):
        x = x * g.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def signed_axes(x: np.ndarray, table: int, n: int) -> np.ndarray:
    """The n nearest signed axes of each row after rotation, nearest first; axis a is 2a, or 2a + 1 where negative."""
    r = rotate(x, table)
    axes = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :n]
    return axes * 2 + (np.take_along_axis(r, axes, axis=1) < 0)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows; cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, by sums whose order depends on the length alone."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), v.alias("v")).where(F.col("vec_id").isNotNull())
            .where(~bad & F.exists("v", lambda x: x != 0)).select("vec_id", "vec", F.size("vec").alias("dim")))


def _rows(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in s])


def _filed(df: DataFrame, keep: list[str], probes: int, tables: int) -> DataFrame:
    """A row for each table and probed bucket."""
    kinds = dict(df.dtypes)

    def run(batches):
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = _rows(part["vec"])
                x = _scaled(x)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for t in range(tables):
                    axes = signed_axes(x, t, probes)
                    for p in range(axes.shape[1]):
                        yield part[keep].assign(t=np.int32(t), bucket=axes[:, p].astype(np.int32))

    return df.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", t int, bucket int")


def _best(k: int):
    def rank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "qh": [], "ids": [], "score": []}
        if len(q) and len(c):
            a, b = _rows(q["vec"]), _rows(c["vec"])
            unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
            ua, ub = unit(_scaled(a)), unit(_scaled(b))
            least = np.array([x[0] for x in c["ids"]])
            for lo in range(0, len(a), 128):
                s = ua[lo:lo + 128] @ ub.T
                n = min(k + 1, s.shape[1])
                cut = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n] - 1e-9
                for r in range(len(s)):
                    j = np.flatnonzero(s[r] >= cut[r])  # all that could be among the best, then exactly
                    exact = cosines(np.broadcast_to(a[lo + r], (len(j), a.shape[1])), b[j])
                    top = np.lexsort((least[j], -exact))[:n]
                    out["query_id"] += [q["query_id"].iat[lo + r]] * len(top)
                    out["qh"] += [q["qh"].iat[lo + r]] * len(top)
                    out["ids"] += [c["ids"].iat[x] for x in j[top]]
                    out["score"] += exact[top].tolist()
        return pd.DataFrame(out)

    return rank


def _ranked(queries: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The best of each tile; both sides carry ``t``, ``bucket`` and ``dim``."""
    key = ["t", "bucket", "dim"]
    size = classes.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).join(
        queries.groupBy(*key).agg(F.ceil(F.count("*") / QUERY_TILE).cast("int").alias("qtiles")), key)
    c = classes.join(size, key).withColumn("ct", F.pmod(F.xxhash64("vec"), F.col("tiles")).cast("int")).withColumn(
        "qt", F.explode(F.sequence(F.lit(0), F.col("qtiles") - 1)))
    q = queries.join(size, key).withColumn("qt", F.pmod(F.xxhash64("query_id", "qh"), F.col("qtiles")).cast("int")).withColumn(
        "ct", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key += ["ct", "qt"]
    q, c = q.select(*key, "query_id", "qh", "vec"), c.select(*key, "vec", "ids")
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(_best(k), "query_id long, qh long, ids array<long>, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    one = found.select("query_id", "qh", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    one = one.groupBy("query_id", "qh", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine), ties to the smaller id.

    ``queries`` has the columns of ``vectors``. A row is no candidate of a
    query with its own id. Rows with a null id, and vectors that are null,
    empty, zero or hold null or non-finite components take no part; vectors of
    different lengths are not compared. Equal rows count once. Empty tables
    give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ready(spark)
    # equal vectors: the k + 1 smallest ids are all that a query can need (limited before the shuffle by the row number's filter)
    w = Window.partitionBy("vec").orderBy("vec_id")
    least = _valid(vectors, id_col, vec_col).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    classes = written(least.groupBy("vec", "dim").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "ann-classes")
    q = _valid(queries, id_col, vec_col).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("qh"), "vec", "dim").distinct()
    q = written(q, "ann-queries")
    parts = n_partitions(classes.count(), 20_000, shuffle_partitions(spark))
    classes, q = classes.repartition(parts), q.repartition(parts)
    found = _ranked(_filed(q, ["query_id", "qh", "vec", "dim"], probes, tables), _filed(classes, ["vec", "dim", "ids"], 1, tables), k)
    top = written(_top(found, k), "ann-top")
    # the rest: queries with fewer than k found meet all rows
    full = top.where(F.col("rank") == k).select("query_id", "qh")
    rest = written(q.join(full, ["query_id", "qh"], "left_anti"), "ann-rest")
    if not rest.isEmpty():
        whole = lambda df: df.withColumn("t", F.lit(0)).withColumn("bucket", F.lit(0))
        top = top.join(rest.select("query_id", "qh"), ["query_id", "qh"], "left_anti").unionByName(_top(_ranked(whole(rest), whole(classes), k), k))
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
