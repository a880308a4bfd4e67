"""V7: interventional Shapley attributions as one Spark job: exact up to 10 features, sampled with a standard error for any number.

For M features, every row is paired with every coalition S (2^M masks) and
every background row b: the model scores x_S + b_(not S). v(S) is the mean
margin over the background. Because each phi_i is a fixed linear
combination of the v(S), phi_i = sum_S v(S) c_i(S) with
c_i(S) = w(|S| - 1) if i in S else -w(|S|), w(s) = s! (M - s - 1)! / M!,
the attribution is one grouped sum per row over the scored margins: one
shuffle, no self-join of coalitions.
An ensemble of trees needs no scored coalitions: a leaf's part of the margin
depends on which of its path's conditions the row and a background row meet, so
the attributions of every pattern of met conditions are tables made once
(``_Paths``), the same numbers from one pass over the rows.
The coalitions (2^M, M <= 10) and the background sample (<= 100 rows) are
bounded literal lists, so each row expands by a fixed factor via explode.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.expressions import md5_hex
from churnlens.session import ship_package

MAX_FEATURES = 10
MAX_BACKGROUND = 100
#: Numbers that the tables of an ensemble may have; coalitions are scored beyond that.
MAX_TABLE = 1 << 23
#: Scored rows of a task, about.
SCORED_ROWS = 1 << 22


def _coefs(m: int) -> list[list[float]]:
    w = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    out = []
    for mask in range(1 << m):
        size = bin(mask).count("1")
        out.append([w[size - 1] if mask >> i & 1 else -w[size] for i in range(m)])
    return out


def background_sample(df: DataFrame, n: int = MAX_BACKGROUND, key: str = "Customer_ID", seed: int = 17) -> DataFrame:
    """The first n rows in hash order (a bounded, reproducible sample)."""
    return df.withColumn("_h", md5_hex(seed, key)).orderBy("_h").limit(n).drop("_h")


def _background(background: DataFrame, features) -> list:
    rows = background.select(*[F.col(c).cast("double") for c in features]).limit(MAX_BACKGROUND + 1).collect()
    if not 0 < len(rows) <= MAX_BACKGROUND:
        raise ValueError("background sample needs 1 to 100 rows")
    return rows


class _Paths:
    """The leaves of an ensemble as conditions ``low < x <= high`` on at most ``width`` features each, and their share of the margin."""

    def __init__(self, trees, m: int):
        leaves = []
        for weight, feature, threshold, left, right, prediction in trees.trees:
            todo = [(0, {})]
            while todo:
                at, path = todo.pop()
                if left[at] == at:
                    leaves.append((path, 2 * weight * prediction[at]))
                    continue
                f, t = int(feature[at]), float(threshold[at])
                lo, hi = path.get(f, (-np.inf, np.inf))
                todo += [(int(left[at]), {**path, f: (lo, min(hi, t))}), (int(right[at]), {**path, f: (max(lo, t), hi)})]
        self.m, self.n, self.width = m, len(leaves), max([1, *[len(p) for p, _ in leaves]])
        self.feature = np.zeros((self.n, self.width), dtype=np.int64)       # conditions that are left over always hold
        self.low, self.high = np.full(self.feature.shape, -np.inf), np.full(self.feature.shape, np.inf)
        self.value = np.array([v for _, v in leaves])
        for i, (path, _) in enumerate(leaves):
            for j, (f, (lo, hi)) in enumerate(path.items()):
                self.feature[i, j], self.low[i, j], self.high[i, j] = f, lo, hi
        self.slot = [np.eye(m)[self.feature[:, j]] for j in range(self.width)]

    def met(self, x: np.ndarray) -> np.ndarray:
        """For every row and leaf the conditions that hold, as bits."""
        out = np.zeros((len(x), self.n), dtype=np.int64)
        for j in range(self.width):
            v = x[:, self.feature[:, j]]
            out |= ((v > self.low[:, j]) & (v <= self.high[:, j])).astype(np.int64) << j
        return out

    def exact(self, background: np.ndarray) -> np.ndarray:
        """(leaf, pattern of the row, condition): attributions over all coalitions, averaged over the background."""
        w, full = self.width, (1 << self.width) - 1
        share = np.stack([(self.met(background) == b).mean(axis=0) for b in range(full + 1)], axis=1)
        fact = math.factorial
        coef = np.zeros((full + 1, full + 1, w))
        for x in range(full + 1):
            for b in range(full + 1):
                own, other = x & ~b, b & ~x
                p, q = own.bit_count(), other.bit_count()
                for j in range(w) if x | b == full else []:     # otherwise no coalition reaches the leaf
                    if own >> j & 1:
                        coef[x, b, j] = fact(p - 1) * fact(q) / fact(p + q)
                    elif other >> j & 1:
                        coef[x, b, j] = -fact(p) * fact(q - 1) / fact(p + q)
        return self.value[:, None, None] * np.einsum("lb,xbj->lxj", share, coef)

    def paired(self, background: np.ndarray, orders: np.ndarray) -> np.ndarray:
        """(leaf, pattern of the row, pair, condition): what a leaf adds on the way through both orders of a pair, halved."""
        w, full = self.width, (1 << self.width) - 1
        b = self.met(background).T[:, None, :]                          # leaf, 1, pair
        x = np.arange(full + 1)[None, :, None]
        reached = (x | b) == full
        bit = lambda v, j: (v >> j & 1).astype(bool)
        out = np.zeros((self.n, full + 1, len(background), w))
        for place in (orders, self.m - 1 - orders):
            at = np.stack([place[:, self.feature[:, j]].T[:, None, :] for j in range(w)], axis=-1)      # leaf, 1, pair, condition
            own = np.stack([bit(x & ~b, j) for j in range(w)], axis=-1)
            other = np.stack([bit(b & ~x, j) for j in range(w)], axis=-1)
            on = np.where(own, at, -1).max(axis=-1)                     # the step that turns the leaf on, and the one that turns it off
            off = np.where(other, at, self.m).min(axis=-1)
            live = (reached & (on < off))[..., None]
            out += np.where(live & own & (at == on[..., None]), 0.5, 0.0) - np.where(live & other & (at == off[..., None]), 0.5, 0.0)
        return self.value[:, None, None, None] * out


def _paths(trees, m: int, pairs: int = 1) -> _Paths | None:
    """The paths of an ensemble, if their tables are small enough for every task."""
    p = _Paths(trees, m) if trees is not None else None
    return p if p and p.n * (p.width + m) * pairs << p.width <= MAX_TABLE else None


def _attributed(scored: DataFrame, key: str, features, base: float, phi) -> DataFrame:
    """(key, feature, phi, se, base_value, margin) from ``phi(x)``, which gives both for a batch of rows; rows of equal key add up, as scored coalitions do."""
    m = len(features)
    names = [f"_p{i}" for i in range(m)] + [f"_s{i}" for i in range(m)]

    def run(batches):
        for b in batches:
            for s in range(0, len(b), 128):
                part = b.iloc[s:s + 128]
                p, e = phi(np.column_stack([part[f"_x{i}"].to_numpy(np.float64) for i in range(m)]))
                yield pd.DataFrame(np.hstack([p, e]), columns=names).assign(_key=part["_key"].to_numpy(), _m=part["margin"].to_numpy())[["_key", "_m", *names]]

    x = scored.select(F.col(key).alias("_key"), "margin", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    rows = x.mapInPandas(run, f"_key {x.schema['_key'].dataType.simpleString()}, _m double, " + ", ".join(f"{n} double" for n in names))
    agg = rows.groupBy("_key").agg(*[F.sum(n).alias(n) for n in names], F.sum(F.lit(base)).alias("base_value"), F.sum("_m").alias("margin"))
    return agg.select(F.col("_key").alias(key), "base_value", "margin", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_p{i}").alias("phi"), F.col(f"_s{i}").alias("se")) for i, c in enumerate(features)])).alias("s")) \
        .select(key, "s.feature", "s.phi", "s.se", "base_value", "margin")


def _mean_margin(score_fn, bg_rows, features, spark) -> float:
    d = spark.createDataFrame([tuple(float(v) for v in r) for r in bg_rows], ", ".join(f"`{c}` double" for c in features))
    return float(score_fn(d).agg(F.avg("margin")).first()[0])


def shapley(score_fn, rows: DataFrame, background: DataFrame, features, key: str = "Customer_ID", trees=None) -> DataFrame:
    """(key, feature, phi) plus the base value and margin per row.

    ``score_fn(df)`` must add a ``margin`` column for the feature columns of
    ``df``. The check sum_i phi_i + base = margin holds exactly in theory.
    ``trees`` (``trees.StagedTrees``) are those that ``score_fn`` scores with, if it does:
    then each row is scored once, and its attributions are read off the leaves.
    """
    m = len(features)
    if m > MAX_FEATURES:
        raise ValueError("exact Shapley is limited to 10 features; shapley_sampled takes any number")
    bg_rows = _background(background, features)
    paths = _paths(trees, m)
    if paths:
        ship_package(rows.sparkSession)
        table = paths.exact(np.array(bg_rows, dtype=np.float64))

        def phi(x):
            at = (np.arange(paths.n)[None], paths.met(x))
            p = sum(table[..., j][at] @ paths.slot[j] for j in range(paths.width))
            return p, np.zeros_like(p)

        return _attributed(score_fn(rows.select(key, *[F.col(c).cast("double") for c in features])), key, features,
                           _mean_margin(score_fn, bg_rows, features, rows.sparkSession), phi).drop("se")
    masks = F.array(*[F.lit(i) for i in range(1 << m)])
    bg = F.array(*[F.struct(*[F.lit(float(r[i])).alias("b_" + c) for i, c in enumerate(features)]) for r in bg_rows])
    coef = F.array(*[F.array(*[F.lit(v) for v in row]) for row in _coefs(m)])
    x = rows.select(key, *[F.col(c).cast("double") for c in features])
    ex = x.select(key, *features, F.explode(masks).alias("mask")).select(key, "mask", *features,
                                                                         F.explode(bg).alias("_bg"))
    mixed = ex.select(key, "mask", *[
        F.when(F.shiftright(F.col("mask"), i).bitwiseAND(1) == 1, F.col(c)).otherwise(F.col("_bg.b_" + c)).alias(c)
        for i, c in enumerate(features)])
    # phi is linear in the margins, so one sum per row, combined on the map side, does without v(S)
    scored = score_fn(mixed).select(key, "mask", (F.col("margin") / len(bg_rows)).alias("_v"), F.element_at(coef, F.col("mask") + 1).alias("_c"))
    full = (1 << m) - 1
    agg = scored.groupBy(key).agg(*[F.sum(F.col("_v") * F.col("_c")[i]).alias(c) for i, c in enumerate(features)],
                                  F.sum(F.when(F.col("mask") == 0, F.col("_v"))).alias("base_value"),
                                  F.sum(F.when(F.col("mask") == full, F.col("_v"))).alias("margin"))
    long = agg.select(key, "base_value", "margin", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("phi")) for c in features])).alias("s"))
    return long.select(key, "s.feature", "s.phi", "base_value", "margin")


def shapley_sampled(score_fn, rows: DataFrame, background: DataFrame, features, key: str = "Customer_ID", rounds: int = 1, seed: int = 17, trees=None) -> DataFrame:
    """(key, feature, phi, se, base_value, margin) for any number of features.

    Coalitions are sampled as pairs of orders: a random order of the features
    and the same backwards. On the way through an order the row's values replace
    those of a background row one by one, and each feature gets the change of
    the margin that it brings. Every background row serves ``rounds`` pairs, so
    the base value is exact, and so is every attribution of an additive model;
    ``se`` is the standard error over the pairs (0 for one pair). The attributions
    of a row add up to its margin less the base value. A row is scored
    2 (M + 1) times a pair: the work grows with M, not with 2^M. ``trees``
    as for :func:`shapley`: the same pairs and numbers from the leaves. There the ``se`` of
    rows of equal key is the sum of theirs.
    """
    m, bg_rows = len(features), _background(background, features)
    rng = np.random.RandomState(seed)
    orders = []
    for i in range(rounds * len(bg_rows)):
        order = rng.permutation(m)
        orders += [(i, order), (i, order[::-1])]
    paths = _paths(trees, m, len(orders) // 2)
    if paths:
        ship_package(rows.sparkSession)
        n = len(orders) // 2
        table = paths.paired(np.array([bg_rows[i % len(bg_rows)] for i in range(n)], dtype=np.float64), np.stack([np.argsort(o) for _, o in orders[::2]]))
        dense = sum(table[..., j, None] * paths.slot[j][:, None, None, :] for j in range(paths.width)).reshape(paths.n << paths.width, n * m)

        def phi(x):
            hot = np.zeros((len(x), paths.n << paths.width))
            hot[np.arange(len(x))[:, None], (np.arange(paths.n)[None] << paths.width) + paths.met(x)] = 1
            g = (hot @ dense).reshape(len(x), n, m)
            return g.mean(axis=1), g.std(axis=1, ddof=1) / math.sqrt(n) if n > 1 else np.zeros((len(x), m))

        return _attributed(score_fn(rows.select(key, *[F.col(c).cast("double") for c in features])), key, features,
                           _mean_margin(score_fn, bg_rows, features, rows.sparkSession), phi)
    # for each order the place of every feature: literal lists, bounded by rounds x 200 x M
    place = F.array(*[F.array(*[F.lit(int(x)) for x in np.argsort(o)]) for _, o in orders])
    bg = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in bg_rows])
    x = rows.select(F.col(key).alias("_key"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    # a task scores and sums a bounded number of rows, whatever the table: nothing is shuffled after the rows are dealt by key
    x = x.repartition(max(1, -(-rows.count() * len(orders) * (m + 1) // SCORED_ROWS), rows.sparkSession.sparkContext.defaultParallelism), "_key")
    ex = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("_o"))
    ex = ex.select("*", F.element_at(place, F.col("_o") + 1).alias("_place"), F.element_at(bg, F.floor(F.col("_o") / 2).cast("int") % len(bg_rows) + 1).alias("_b"))
    ex = ex.select("*", F.explode(F.sequence(F.lit(0), F.lit(m))).alias("_step"))
    mixed = ex.select("_key", "_o", "_step", "_place", *[F.when(F.col("_place")[i] < F.col("_step"), F.col("_x")[i]).otherwise(F.col("_b")[i]).alias(c) for i, c in enumerate(features)])
    v, step = F.col("margin"), F.col("_step")
    gain = [F.sum(F.when(F.col("_place")[i] == step - 1, v).when(F.col("_place")[i] == step, -v).otherwise(0.0)) / 2 for i in range(m)]
    pairs = score_fn(mixed).groupBy("_key", F.floor(F.col("_o") / 2).alias("_pair")).agg(
        *[g.alias(f"_g{i}") for i, g in enumerate(gain)], (F.sum(F.when(step == 0, v)) / 2).alias("_base"), (F.sum(F.when(step == m, v)) / 2).alias("_margin"))
    n = len(orders) // 2
    se = (lambda c: F.stddev_samp(c) / F.lit(float(n) ** 0.5)) if n > 1 else (lambda c: F.lit(0.0))
    agg = pairs.groupBy("_key").agg(*[F.avg(f"_g{i}").alias(f"_p{i}") for i in range(m)], *[se(f"_g{i}").alias(f"_s{i}") for i in range(m)],
                                    F.avg("_base").alias("base_value"), F.avg("_margin").alias("margin"))
    return agg.select(F.col("_key").alias(key), "base_value", "margin", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_p{i}").alias("phi"), F.col(f"_s{i}").alias("se")) for i, c in enumerate(features)])).alias("s")) \
        .select(key, "s.feature", "s.phi", "s.se", "base_value", "margin")


def shapley_summary(phi: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature (the summary-plot ranking)."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")) \
        .orderBy(F.col("mean_abs_phi").desc())
