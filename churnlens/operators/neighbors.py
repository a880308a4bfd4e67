"""Nearest neighbours (K1) and kNN class probabilities (K2).

Exact search leaves out what cannot matter. A bounded sample of base rows is
cut at quantiles of its widest coordinate, again and again, into cells of a
fixed number of rows; every base row belongs to one cell, and a cell knows the
box that its rows fill. Each query first meets the nearest cells that have k
rows between them; its k-th distance there bounds the search: a cell whose
box is farther holds no neighbour, and its rows are never sent to that query.
Rows of one cell and their queries are compared in tiles of bounded size, in
NumPy, by a cogroup; inside a tile, small leaves of the base and small groups
of queries are left out by their boxes likewise. A tile emits the k best rows
of a query, whatever the ties, and a window a query merges the tiles. Cells have
the same number of rows whatever the table, so a query meets about as many rows
in a large table as in a small one. A table of a few blocks has one cell, so one round does.

``knn_approx`` searches only the own cell of a query, in several randomly
rotated partitions, for tables where a share of the neighbours will do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import ship_package, written

METRICS = ("euclidean", "manhattan", "minkowski")
#: Distances this near are rounded to one value, possibly.
_TIE_MARGIN = 1e-8
#: Cells at most: their boxes and distances to some rows are held in each task.
MAX_CELLS = 4096
#: Sampled base rows a cell, from which the cuts are taken.
SAMPLE = 64
#: Blocks of base rows that a cell has, about: below that a second round costs more than it can leave out.
BLOCKS = 4
#: Base rows of a leaf and queries of a group inside a tile.
LEAF, GROUP = 128, 64
#: Partitions of the tiles at most.
MAX_PARTITIONS = 4096


def _dist(q: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of every query row to every base row, feature by feature
    in column order (so sums match a SQL engine adding left to right)."""
    d = np.zeros((q.shape[0], b.shape[0]))
    for j in range(q.shape[1]):
        diff = np.abs(q[:, j][:, None] - b[:, j][None, :])
        if metric == "manhattan" or (metric == "minkowski" and p == 1):
            d += diff
        elif metric == "euclidean" or (metric == "minkowski" and p == 2):
            d += diff * diff
        else:
            d += diff ** p
    if metric == "euclidean" or (metric == "minkowski" and p == 2):
        d = np.sqrt(d)
    elif metric == "minkowski" and p != 1:
        d = d ** (1.0 / p)
    return d


def _best(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite values of each row; columns are in key order.

    Values near the k-th may be rounded to it, so all of these stay; of values
    that are equal the first k do.
    """
    if not d.shape[1] or k < 1:
        return np.zeros(0, int), np.zeros(0, int)
    kk = min(k, d.shape[1])
    last = np.partition(d, kk - 1, axis=1)[:, kk - 1, None]
    mask = (d <= last + _TIE_MARGIN) & np.isfinite(d)
    for i in np.flatnonzero(mask.sum(axis=1) > 2 * kk):    # many equal distances
        at = np.flatnonzero(mask[i])
        order = np.lexsort([at, d[i, at]])
        value = d[i, at[order]]
        first = np.searchsorted(value, value)               # place of the first equal value
        mask[i, at[order[np.arange(len(order)) - first >= kk]]] = False
    return np.nonzero(mask)


def _vectors(col: pd.Series) -> np.ndarray:
    return np.concatenate(col.to_numpy()).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _box_dist(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of every query row to every box (0 inside): no row of the box is nearer."""
    d = np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        x = q[:, j, None]
        gap = np.maximum(np.maximum(lo[None, :, j] - x, x - hi[None, :, j]), 0)
        if metric == "manhattan" or (metric == "minkowski" and p == 1):
            d += gap
        elif metric == "euclidean" or (metric == "minkowski" and p == 2):
            d += gap * gap
        else:
            d += gap ** p
    if metric == "euclidean" or (metric == "minkowski" and p == 2):
        return np.sqrt(d)
    return d ** (1.0 / p) if metric == "minkowski" and p != 1 else d


def _leaves(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the starts of runs of at most ``size`` of them, cut at medians of the widest column (equal rows stay together)."""
    order, starts, todo = np.arange(len(v)), [], [(0, len(v))]
    while todo:
        lo, hi = todo.pop()
        part = v[order[lo:hi]]
        width = np.ptp(part, axis=0) if hi > lo else np.zeros(1)
        if hi - lo <= size or not width.any():
            starts.append(lo)
            continue
        mid = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, width.argmax()], mid)]
        todo += [(lo, lo + mid), (lo + mid, hi)]
    return order, np.sort(np.array(starts))


def _search(qv: np.ndarray, tau: np.ndarray, bv: np.ndarray, k: int, metric: str, p: float, barred):
    """(query rows, base rows, distances) with the k best of ``bv`` for every query that are within its ``tau``.

    ``barred(queries, columns)`` says which pairs do not count. Base rows are in key order.
    """
    order, starts = _leaves(bv, LEAF)
    lo, hi = np.minimum.reduceat(bv[order], starts), np.maximum.reduceat(bv[order], starts)
    leaves = np.split(order, starts[1:])
    sizes = np.array([len(x) for x in leaves])
    q_order, q_starts = _leaves(qv, GROUP)
    groups = [g[s:s + 512] for g in np.split(q_order, q_starts[1:]) for s in range(0, len(g), 512)]     # equal queries can be many

    def distances(g, chosen):
        cols = np.sort(np.concatenate([leaves[i] for i in chosen]))
        d = _dist(qv[g], bv[cols], metric, p)
        d[barred(g, cols)] = np.inf
        return cols, d

    for g in groups:
        gap, t = _box_dist(qv[g], lo, hi, metric, p), tau[g]
        if np.isinf(t).any():
            near = np.argsort(gap.min(axis=0), kind="stable")
            near = near[:np.searchsorted(np.cumsum(sizes[near]), max(2 * k, 2 * LEAF)) + 1]
            _, d = distances(g, near)
            if d.shape[1] >= k:
                t = np.minimum(t, np.partition(d, k - 1, axis=1)[:, k - 1])
        t = t[:, None] + _TIE_MARGIN
        need = np.flatnonzero((gap <= t).any(axis=0))
        if not len(need):
            continue
        cols, d = distances(g, need)
        d[d > t] = np.inf
        r, c = _best(d, k)
        yield g[r], cols[c], d[r, c]


class _Pivots:
    """Pivot vectors with the radius and the number of rows of each."""

    def __init__(self, vectors: np.ndarray, metric: str, p: float):
        self.vectors, self.metric, self.p = vectors, metric, p
        self.radius, self.count = np.zeros(len(vectors)), np.zeros(len(vectors), dtype=np.int64)

    def distances(self, v: np.ndarray) -> np.ndarray:
        return _dist(v, self.vectors, self.metric, self.p)


class _Cells(_Pivots):
    """Boxes cut from a sample, with the number of rows of each; the distance to a cell is that to its box, so it has no radius."""

    def __init__(self, sample: np.ndarray, cells: int, metric: str, p: float):
        self.cuts: list = []            # column, value, child for at most, child for more; a child -(i + 1) is cell i
        n = 0

        def cut(rows: np.ndarray, wanted: int) -> int:
            nonlocal n
            if wanted > 1 and len(rows) > 1:
                a, z = np.quantile(rows, [0.05, 0.95], axis=0)
                col = int((z - a).argmax()) if (z > a).any() else int(np.ptp(rows, axis=0).argmax())
                x = np.sort(rows[:, col])
                at = x[max(0, len(x) * (wanted // 2) // wanted - 1)]
                at = at if at < x[-1] else x[max(0, np.searchsorted(x, x[-1]) - 1)]
                if at < x[-1]:
                    me = len(self.cuts)
                    self.cuts.append(None)
                    low = rows[:, col] <= at
                    self.cuts[me] = (col, float(at), cut(rows[low], wanted // 2), cut(rows[~low], wanted - wanted // 2))
                    return me
            n += 1
            return -n

        self.root = cut(sample, cells)
        super().__init__(np.zeros((n, sample.shape[1])), metric, p)
        self.lo, self.hi = np.full(self.vectors.shape, np.inf), np.full(self.vectors.shape, -np.inf)

    def home(self, v: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(v), dtype=np.int32), [(self.root, np.arange(len(v)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -at - 1
            elif len(rows):
                col, value, less, more = self.cuts[at]
                low = v[rows, col] <= value
                todo += [(less, rows[low]), (more, rows[~low])]
        return out

    def measure(self, rows: DataFrame) -> None:
        """Number and box of the rows of each cell (one row a cell)."""
        m = range(self.vectors.shape[1])
        for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("v")[j]).alias(f"{a}{j}") for j in m for f, a in ((F.min, "lo"), (F.max, "hi"))]).collect():
            self.count[r["c"]] = r["n"]
            self.lo[r["c"]], self.hi[r["c"]] = [r[f"lo{j}"] for j in m], [r[f"hi{j}"] for j in m]

    def distances(self, v: np.ndarray) -> np.ndarray:
        return _box_dist(v, self.lo, self.hi, self.metric, self.p)


def _with_home(rows: DataFrame, cells: _Cells) -> DataFrame:
    """``rows`` with ``c``, the cell that they lie in."""
    def run(batches):
        for b in batches:
            yield b.assign(c=cells.home(_vectors(b["v"])) if len(b) else np.zeros(0, np.int32))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{types}, c int")


def _finite(rows: DataFrame) -> DataFrame:
    """Rows without a missing or infinite feature: no distance of the others counts."""
    return rows.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))


def _sampled(rows: DataFrame, n: int, of: int) -> np.ndarray:
    """About ``n`` vectors of ``of``, at most four times as many, chosen by a hash."""
    share = F.pmod(F.xxhash64("nid", "v"), F.lit(1 << 30)) < F.lit(int(min(1.0, n / max(1, of)) * (1 << 30)))
    got = rows.where(share).select("v").limit(4 * n).toPandas()["v"]
    return np.unique(_vectors(got), axis=0)


def _visits(rows: DataFrame, pivots: _Pivots, least: int, bounded: bool) -> DataFrame:
    """``rows`` once for each pivot to visit (``c``).

    First round: the nearest pivots with ``least`` rows together. Second
    round (``bounded``: rows have their k-th distance ``tau``, null if fewer were
    found): all others that may hold a nearer row.
    """
    def run(batches):
        for b in (b.iloc[s:s + 1024] for b in batches for s in range(0, len(b), 1024)):     # rows x cells distances are held
            d = pivots.distances(_vectors(b["v"]))
            order = np.argsort(d, axis=1, kind="stable")
            have = np.cumsum(pivots.count[order], axis=1)
            need = np.concatenate([np.zeros((len(b), 1), bool), have[:, :-1] >= least], axis=1)
            first = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(first, order, ~need, axis=1)
            if bounded:
                tau = b["tau"].fillna(np.inf).to_numpy()[:, None] + _TIE_MARGIN
                first = ~first & (d - pivots.radius <= tau)
            i, c = np.nonzero(first)
            yield b.iloc[i].assign(c=c.astype(np.int32))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{types}, c int")


def _dealt(visits: DataFrame, base: DataFrame, pivots: _Pivots, block: int, tile, schema: str, base_block: int | None = None) -> DataFrame:
    """``tile(queries, base rows)`` of every cell, whose rows are dealt to blocks of bounded size."""
    asked = {r["c"]: r["n"] for r in visits.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}     # a number a cell
    of = {c: int(n) for c, n in enumerate(pivots.count)}
    q_block, b_block = block, base_block or (block if len(of) == 1 else 2 * BLOCKS * block)
    blocks = lambda counts, c, size: max(1, math.ceil(counts.get(c, 0) / size))

    def parts(counts: dict[int, int], size: int):
        """How many blocks the rows of cell ``c`` are dealt to."""
        return F.element_at(F.array(*[F.lit(blocks(counts, c, size)) for c in range(len(of))]), F.col("c") + 1)

    q = visits if "tau" in visits.columns else visits.withColumn("tau", F.lit(None).cast("double"))
    q = q.withColumn("i", F.pmod(F.xxhash64("qid"), parts(asked, q_block)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), parts(of, b_block) - 1)))
    b = base.where(F.col("c").isin(list(asked))) if asked else base.where("false")
    b = b.withColumn("j", F.pmod(F.xxhash64("nid"), parts(of, b_block)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), parts(asked, q_block) - 1)))
    # as many partitions as tiles keep busy: the tables are small in bytes, not in work
    n = min(MAX_PARTITIONS, 3 * sum(blocks(asked, c, q_block) * blocks(of, c, b_block) for c in asked) or 1)
    key = ("c", "i", "j")
    return q.repartition(n, *key).groupBy(*key).cogroup(b.repartition(n, *key).groupBy(*key)).applyInPandas(tile, schema)


def _tiles(visits: DataFrame, base: DataFrame, pivots: _Pivots, k: int, block: int, exclude_self: bool) -> DataFrame:
    """Candidates (qid, nid, d, _y): the k best of every query in every tile, within its ``tau`` if it has one."""
    metric, p = pivots.metric, pivots.p

    def tile(qdf: pd.DataFrame, bdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": qdf["qid"].iloc[:0], "nid": bdf["nid"].iloc[:0], "d": [], "_y": []})
        if qdf.empty or bdf.empty or k < 1:
            return empty
        bdf = bdf.sort_values("nid", kind="stable")
        qids, nids, ys = qdf["qid"].to_numpy(), bdf["nid"].to_numpy(), bdf["_y"].to_numpy(dtype=np.float64)
        apart = qdf["_g"].to_numpy(), bdf["_g"].to_numpy()

        def barred(g, cols):
            out = apart[0][g][:, None] == apart[1][cols][None, :]
            return out | (qids[g][:, None] == nids[cols][None, :]) if exclude_self else out

        out = list(_search(_vectors(qdf["v"]), qdf["tau"].fillna(np.inf).to_numpy(np.float64), _vectors(bdf["v"]), k, metric, p, barred))
        if not out:
            return empty
        r, c, d = map(np.concatenate, zip(*out))
        return pd.DataFrame({"qid": qids[r], "nid": nids[c], "d": d, "_y": ys[c]})

    qt, bt = visits.schema["qid"].dataType.simpleString(), base.schema["nid"].dataType.simpleString()
    return _dealt(visits, base, pivots, block, tile, f"qid {qt}, nid {bt}, d double, _y double")


def _needed(d: np.ndarray, member: np.ndarray, k: int) -> np.ndarray:
    """Which of some rows, in order of their distances ``d``, are among the k nearest of any layer (``member``: layers x rows).

    Values near the k-th may be rounded to it, so all of these stay; of values that are equal the first k do.
    """
    before = np.cumsum(member, axis=1, dtype=np.int32) - member             # members in front
    near, same = np.searchsorted(d, d - _TIE_MARGIN), np.searchsorted(d, d)
    return (member & (before[:, near] < k) & (before - before[:, same] < k)).any(axis=0)


def _kth_of_layers(d: np.ndarray, member: np.ndarray, k: int) -> float:
    """The largest of the layers' k-th distances (infinite if a layer has fewer rows)."""
    n = np.cumsum(member, axis=1, dtype=np.int32)
    return float(d[(n < k).sum(axis=1).max()]) if d.size and (n[:, -1] >= k).all() else np.inf


def _search_layers(qv: np.ndarray, tau: np.ndarray, bv: np.ndarray, member: np.ndarray, k: int, metric: str, p: float):
    """(query, its base rows, their distances): the k nearest rows of every layer within ``tau``, each row once. Base rows are in key order."""
    order, starts = _leaves(bv, LEAF)
    lo, hi = np.minimum.reduceat(bv[order], starts), np.maximum.reduceat(bv[order], starts)
    leaves = np.split(order, starts[1:])
    has = np.stack([member[:, x].sum(axis=1) for x in leaves])              # leaves x layers
    q_order, q_starts = _leaves(qv, GROUP)

    def distances(g, chosen):
        cols = np.sort(np.concatenate([leaves[i] for i in chosen]))
        return cols, _dist(qv[g], bv[cols], metric, p)

    for g in [g[s:s + GROUP] for g in np.split(q_order, q_starts[1:]) for s in range(0, len(g), GROUP)]:
        gap, t = _box_dist(qv[g], lo, hi, metric, p), tau[g]
        near = np.argsort(gap.min(axis=0), kind="stable")
        have = np.cumsum(has[near], axis=0)
        if np.isinf(t).any() and (have[-1] >= k).all():
            cols, d = distances(g, near[:int((have < 2 * k).any(axis=1).sum()) + 1])
            for i in np.flatnonzero(np.isinf(t)):
                o = np.argsort(d[i], kind="stable")
                t[i] = _kth_of_layers(d[i, o], member[:, cols[o]], k)
        t = t + _TIE_MARGIN
        need = np.flatnonzero((gap <= t[:, None]).any(axis=0))
        if not len(need):
            continue
        cols, d = distances(g, need)
        for i, q in enumerate(g):
            at = np.flatnonzero(d[i] <= t[i])
            at = at[np.argsort(d[i, at], kind="stable")]
            at = at[_needed(d[i, at], member[:, cols[at]], k)] if len(at) else at
            if len(at):
                yield q, cols[at], d[i, at]


def knn_layers(rows: DataFrame, members, k: int, metric: str = "euclidean", p: float = 2.0, block: int = 4096, base_block: int | None = None) -> DataFrame:
    """(qid, near): for every row the rows that are among its k nearest in any of some overlapping subsets of the table, exactly.

    ``rows`` has ``nid``, ``v``, ``_y`` (int) and ``_at``, bytes from which
    ``members(ats)`` tells the memberships (subsets x rows). ``near``
    holds structs of ``d``, ``nid``, ``y`` and ``at``, in no order, with rows near the
    k-th (they may be rounded to it). The cells, the two rounds and the tiles
    are those of :func:`knn_topk`; a query's bound is the largest of its layers'.
    """
    ship_package(rows.sparkSession)
    b = written(_finite(rows), "knn-layers")
    nb = b.count()
    n_cells = min(MAX_CELLS, max(1, math.ceil(nb / (BLOCKS * block))))
    cells = _Cells(_sampled(b, SAMPLE * n_cells, nb), n_cells, metric, p) if n_cells > 1 else None
    nt = b.schema["nid"].dataType.simpleString()
    near = f"qid {nt}, d array<double>, nid array<{nt}>, y array<int>, at array<binary>"

    def tile(qdf: pd.DataFrame, bdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"qid": [], "d": [], "nid": [], "y": [], "at": []}
        if len(qdf) and len(bdf) and k > 0:
            bdf = bdf.sort_values("nid", kind="stable")
            qids, nids, ys, ats = qdf["qid"].to_numpy(), bdf["nid"].to_numpy(), bdf["_y"].to_numpy(), bdf["_at"].to_numpy()
            tau = qdf["tau"].fillna(np.inf).to_numpy(np.float64).copy()
            for q, cols, d in _search_layers(_vectors(qdf["v"]), tau, _vectors(bdf["v"]), members(ats), k, metric, p):
                for name, x in (("qid", qids[q]), ("d", d), ("nid", nids[cols]), ("y", ys[cols]), ("at", list(ats[cols]))):
                    out[name].append(x)
        return pd.DataFrame({"qid": pd.Series(out["qid"], dtype=qdf["qid"].dtype)} | {c: pd.Series(out[c], dtype=object) for c in ("d", "nid", "y", "at")})

    def bounds(batches):
        for x in batches:
            tau = []
            for d, ats in zip(x["d"], x["at"]):
                o = np.argsort(d, kind="stable")
                tau.append(_kth_of_layers(np.asarray(d)[o], members(ats)[:, o], k))
            yield pd.DataFrame({"qid": x["qid"], "tau": tau})

    def gathered(cand):
        flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("d", "nid", "y", "at")]     # of one cell or a few: the lists of a query keep step
        return cand.groupBy("qid").agg(*flat)

    q = b.select(F.col("nid").alias("qid"), F.transform("v", lambda x: x).alias("v"))      # a column of its own: a cogroup would take both sides' for one
    if cells is None or len(cells.count) < 2:
        cells = _Pivots(np.zeros((1, 1)), metric, p)
        cells.count[0] = nb
        cand = _dealt(q.withColumn("c", F.lit(0)), b.withColumn("c", F.lit(0)), cells, block, tile, near, base_block)
    else:
        b = written(_with_home(b, cells), "knn-base")
        cells.measure(b)
        cand = written(_dealt(written(_visits(q, cells, k, False), "knn-first"), b, cells, block, tile, near, base_block), "knn-near")
        tau = gathered(cand).select("qid", "d", "at").mapInPandas(bounds, f"qid {nt}, tau double")
        far = written(_visits(q.join(tau, "qid", "left"), cells, k, True), "knn-second")
        cand = cand.unionByName(_dealt(far, b, cells, block, tile, near, base_block))
    return cand.select("qid", F.arrays_zip("d", "nid", "y", "at").alias("s")).groupBy("qid").agg(F.flatten(F.collect_list("s")).alias("near"))


def knn_topk(query: DataFrame, base: DataFrame, features, k: int = 5, metric: str = "euclidean", p: float = 2.0,
             query_key: str = "Customer_ID", base_key: str = "Customer_ID", exclude_self: bool = False, block: int = 4096, places: int = 9,
             carry: str | None = None, apart: str | None = None) -> DataFrame:
    """(qid, nid, distance, rank): the k nearest base rows of every query row, exactly.

    Distances are rounded to ``places``; ties at rank k go to the smaller
    base key. ``exclude_self`` drops pairs with equal keys (neighbours within
    one table). ``carry`` names a base column (e.g. the label) returned as
    ``_y`` with each neighbour, so no join back to the base is needed.
    ``apart`` names a column of both tables whose equal values are no
    neighbours (the fold: all folds of a cross-validation in one pass).
    """
    ship_package(query.sparkSession)
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    feats = F.array(*[F.col(c).cast("double") for c in features])
    group = F.col(apart).cast("int") if apart else F.lit(None).cast("int")
    q = query.select(F.col(query_key).alias("qid"), feats.alias("v"), F.coalesce(group, F.lit(-1)).alias("_g"))
    b = base.select(F.col(base_key).alias("nid"), feats.alias("v"), (F.col(carry).cast("double") if carry else F.lit(None).cast("double")).alias("_y"),
                    F.coalesce(group, F.lit(-2)).alias("_g"))
    q, b = _finite(q), _finite(b)
    nb = b.count()
    n_cells = min(MAX_CELLS, max(1, math.ceil(nb / (BLOCKS * block))))
    cells = _Cells(_sampled(b, SAMPLE * n_cells, nb), n_cells, metric, p) if n_cells > 1 else None
    if cells is None or len(cells.count) < 2:
        cells = _Pivots(np.zeros((1, 1)), metric, p)
        cells.count[0] = nb
        cand = _tiles(q.withColumn("c", F.lit(0)), b.withColumn("c", F.lit(0)), cells, k, block, exclude_self)
    else:
        b = written(_with_home(b, cells), "knn-base")
        cells.measure(b)
        least = (2 * k if apart else k) + exclude_self      # some of them may not count; too few only widen the second round
        cand = written(_tiles(written(_visits(q, cells, least, False), "knn-first"), b, cells, k, block, exclude_self), "knn-near")
        kth = cand.groupBy("qid").agg(F.try_element_at(F.sort_array(F.collect_list("d")), F.lit(k)).alias("tau"))    # some k distances a query
        far = written(_visits(q.join(kth, "qid", "left"), cells, least, True), "knn-second")
        cand = cand.unionByName(_tiles(far, b, cells, k, block, exclude_self))
    cand = cand.withColumn("distance", F.round("d", places))
    w = Window.partitionBy("qid").orderBy("distance", "nid")
    out = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("d")
    return out if carry else out.drop("_y")


def knn_approx(query: DataFrame, base: DataFrame, features, k: int = 5, query_key: str = "Customer_ID", base_key: str = "Customer_ID",
               tables: int = 6, sample: int = 256, widen: float = 2.0, seed: int = 17, exclude_self: bool = False, places: int = 9) -> DataFrame:
    """(qid, nid, distance, rank): approximate euclidean neighbours from randomly rotated partitions of the base.

    Each of ``tables`` partitions rotates all vectors at random and cuts them
    into cells of about ``widen`` x ``sample`` x 16 rows by a sample of at most
    ``sample`` rows a cell; a query is compared with the rows of its own cell of each. The
    work a query does not grow with the table. Neighbours beyond a cut of every
    partition are missed: this is the approximate choice, ``knn_topk`` the exact one.
    """
    ship_package(query.sparkSession)
    feats = F.array(*[F.col(c).cast("double") for c in features])
    q = _finite(query.select(F.col(query_key).alias("qid"), feats.alias("v"), F.lit(-1).alias("_g")))
    b = _finite(base.select(F.col(base_key).alias("nid"), feats.alias("v"), F.lit(None).cast("double").alias("_y"), F.lit(-2).alias("_g")))
    nb = b.count()
    size = int(widen * sample * 16)
    n_cells = min(MAX_CELLS, max(1, math.ceil(nb / size)))
    drawn = _sampled(b, min(sample, SAMPLE) * n_cells, nb) if n_cells > 1 else np.zeros((0, len(features)))
    parts, first = [], 0
    for t in range(tables if len(drawn) > 1 else 1):
        turn, _ = np.linalg.qr(np.random.RandomState(seed + t).normal(size=(len(features), len(features))))
        cells = _Cells(drawn @ turn, n_cells, "euclidean", 2.0) if len(drawn) > 1 else None
        parts.append((turn, cells, first))
        first += len(cells.count) if cells else 1

    def homes(batches):
        for x in batches:
            v = _vectors(x["v"])
            for turn, cells, start in parts if len(x) else []:
                yield x.assign(c=(cells.home(v @ turn) if cells else np.zeros(len(x), np.int32)) + np.int32(start))

    def dealt(rows):
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return written(rows.mapInPandas(homes, f"{types}, c int"), "knn-rotated")

    b = dealt(b)
    pivots = _Pivots(np.zeros((first, 1)), "euclidean", 2.0)
    for r in b.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect():       # a row a cell
        pivots.count[r["c"]] = r["n"]
    j = _tiles(dealt(q), b, pivots, k, size // (2 * BLOCKS) if first > 1 else size, exclude_self)
    j = j.select("qid", "nid", F.round("d", places).alias("distance")).distinct()      # found in several partitions
    w = Window.partitionBy("qid").orderBy("distance", "nid")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "nid", "distance", "rank")


def knn_proba(topk: DataFrame, base: DataFrame, label: str = "Left", base_key: str = "Customer_ID",
              weights: str = "uniform", k: int | None = None, places: int = 9) -> DataFrame:
    """K2: (qid, proba, pred) from the neighbour table.

    uniform: share of positive neighbours; distance: weights 1 / d, and if
    any neighbour is at distance 0 only those vote. pred = proba > 0.5
    (a tie goes to class 0).
    """
    t = topk if k is None else topk.where(F.col("rank") <= k)
    if "_y" in t.columns:                   # label carried by knn_topk: no join back to the base
        j = t.withColumn("_y", F.col("_y").cast("int"))
    else:
        lab = base.select(F.col(base_key).alias("nid"), F.col(label).cast("int").alias("_y"))
        j = t.join(lab, "nid")
    y, d = F.col("_y"), F.col("distance")
    if weights == "uniform":
        proba = F.sum(y) / F.count(F.lit(1))
    else:
        zero = F.sum(F.when(d == 0, 1).otherwise(0))
        proba = F.when(zero > 0, F.sum(F.when(d == 0, y).otherwise(0)) / zero) \
            .otherwise(F.sum(F.try_divide(y, d)) / F.sum(F.try_divide(F.lit(1.0), d)))
    g = j.groupBy("qid").agg(F.round(proba, places).alias("proba"))
    return g.withColumn("pred", F.when(F.col("proba") > 0.5, 1).otherwise(0))
