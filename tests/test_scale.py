"""Work that must grow with the table and no faster."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from churnlens.operators import neighbors as K


def test_cells_visited_do_not_grow_with_the_table(spark):
    """With cells of the same size, a query of a table eight times as large meets about as many cells, and misses none that it needs."""
    met = {}
    for n in (2_000, 16_000):
        g = np.random.default_rng(1)
        x = g.normal(size=(n, 3))
        cells = K._Cells(x[g.permutation(n)[:min(n, 4096)]], n // 100, "euclidean", 2.0)
        home = cells.home(x)
        assert len(cells.count) == n // 100
        for c in range(len(cells.count)):
            own = x[home == c]
            cells.count[c], cells.lo[c], cells.hi[c] = len(own), own.min(axis=0), own.max(axis=0)
        assert (cells.count <= 500).all()
        q = x[:200]
        d = K._dist(q, x, "euclidean", 2.0)
        tau = np.partition(d, 5, axis=1)[:, 5]
        rows = spark.createDataFrame([(i, q[i].tolist(), -1, float(tau[i])) for i in range(200)], "qid long, v array<double>, _g int, tau double")
        seen = K._visits(rows.drop("tau"), cells, 6, False).select("qid", "c").collect() + K._visits(rows, cells, 6, True).select("qid", "c").collect()
        by = {i: {r["c"] for r in seen if r["qid"] == i} for i in range(200)}
        assert all(set(home[d[i] <= tau[i]]) <= by[i] for i in range(200))
        met[n] = len(seen) / 200
    assert met[16_000] < 2 * met[2_000] and met[16_000] < 20


def test_search_in_a_tile_is_exact():
    g = np.random.default_rng(2)
    for metric in ("euclidean", "manhattan"):
        b = np.round(g.normal(size=(3_000, 4)), 1)
        q = np.vstack([np.round(g.normal(size=(90, 4)), 1), np.repeat(b[:1], 700, axis=0)])
        fold = g.integers(0, 3, len(q)), g.integers(0, 3, len(b))
        for tau in (np.full(len(q), np.inf), np.full(len(q), 0.7)):
            out = list(K._search(q, tau, b, 9, metric, 2.0, lambda r, c: fold[0][r][:, None] == fold[1][c][None, :]))
            got = pd.DataFrame(dict(zip("qbd", map(np.concatenate, zip(*out))))).assign(r=lambda t: t["d"].round(9)).sort_values(["q", "r", "b"])
            got = {i: t["b"].tolist()[:9] for i, t in got.groupby("q")}
            d = np.round(K._dist(q, b, metric, 2.0), 9)
            for i in range(0, len(q), 7):
                ok = np.flatnonzero((fold[1] != fold[0][i]) & (d[i] <= tau[i]))
                assert got.get(i, []) == ok[np.lexsort([ok, d[i, ok]])][:9].tolist()


def test_missing_features_have_no_neighbours(spark):
    d = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 1), (3, None, 1), (4, float("nan"), 0), (5, 1.5, 1)], "Customer_ID long, a double, Left int")
    got = K.knn_topk(d, d, ["a"], 2, exclude_self=True, carry="Left").orderBy("qid", "rank").collect()
    assert [(r["qid"], r["nid"]) for r in got] == [(1, 2), (1, 5), (2, 5), (2, 1), (5, 2), (5, 1)]


def test_own_cell_of_rotated_partitions(spark):
    """The approximate search looks at one cell a partition; their number follows the table, and nine tenths are found."""
    g = np.random.default_rng(3)
    pdf = pd.DataFrame(np.round(g.normal(size=(6_000, 5)), 6), columns=list("abcde")).assign(Customer_ID=np.arange(6_000))
    d = spark.createDataFrame(pdf)
    exact = K.knn_topk(d.where("Customer_ID < 300"), d, list("abcde"), 5, exclude_self=True).select("qid", "nid")
    near = K.knn_approx(d.where("Customer_ID < 300"), d, list("abcde"), 5, exclude_self=True)
    assert near.groupBy().agg(F.max("rank")).first()[0] == 5
    assert exact.join(near, ["qid", "nid"]).count() >= 0.9 * 1500


def test_attributions_of_trees_from_their_leaves(spark):
    """The same numbers as from scored coalitions, and every row is scored once."""
    from churnlens.operators import trees as T
    from churnlens.operators.explain import shapley, shapley_sampled
    g = np.random.default_rng(4)
    names = ["a", "b", "c", "e"]
    pdf = pd.DataFrame(np.round(g.normal(size=(300, 4)), 2), columns=names).assign(Customer_ID=np.arange(300))
    pdf["Left"] = ((pdf["a"] * pdf["b"] > 0) | (pdf["c"] > 1)).astype(int)
    d = spark.createDataFrame(pdf)
    m = T.gbt_fit(d, names, max_depth=3, learning_rate=0.3, n_estimators=6, colsample=1.0)
    trees, few, back = T.StagedTrees(T.node_table(m)), d.limit(15), d.orderBy("Customer_ID").limit(7)
    for f, kw in ((shapley, {}), (shapley_sampled, dict(rounds=2))):
        want = f(lambda x: T.gbt_score(m, x, names), few, back, names, **kw)
        scored = []
        got = f(lambda x: scored.append(x.count()) or T.gbt_score(m, x, names), few, back, names, trees=trees, **kw)
        assert got.columns == want.columns and max(scored) <= 15
        j = want.toPandas().merge(got.toPandas(), on=["Customer_ID", "feature"], suffixes=("", "_t"))
        assert len(j) == 60 and j["phi"].abs().max() > 0.1
        for c in set(want.columns) - {"Customer_ID", "feature"}:
            assert np.allclose(j[c], j[f"{c}_t"], atol=1e-9), c


def test_sampled_attributions_shuffle_no_scored_rows(spark, monkeypatch):
    from churnlens.operators import explain as E
    monkeypatch.setattr(E, "SCORED_ROWS", 500)
    d = spark.createDataFrame(pd.DataFrame({"Customer_ID": range(100), "a": np.arange(100.0), "b": np.arange(100.0) ** 2}))
    s = E.shapley_sampled(lambda x: x.withColumn("margin", F.col("a") - F.col("b")), d, d.limit(4), ["a", "b"])
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1      # the rows themselves, in 5 partitions of 20 rows or so
    assert s.count() == 200


def test_networks_of_a_shard_are_shared_out(spark):
    """More tasks train than there are shards, with the same weights."""
    from churnlens.operators import mlp as N
    g = np.random.default_rng(6)
    pdf = pd.DataFrame(g.normal(size=(80, 3)), columns=["a", "b", "c"]).assign(Customer_ID=np.arange(80), Left=np.arange(80) % 2, fold=np.arange(80) % 4)
    t = N.store_shards(spark.createDataFrame(pdf), ["a", "b", "c"], fold_col="fold", shards=2)
    specs = [N.Spec((4,), left_out=f) for f in range(4)]
    s = N.spread(t, specs)
    assert s.select("shard", "part").distinct().count() == 8 and N.spread(t, specs[:1]) is t
    for spec, state in zip(specs, N.fit_many(t, 3, specs, 3), strict=True):
        assert (state.vec == N.fit_many(t, 3, [spec], 3)[0].vec).all()


def test_trees_train_on_equal_parts(spark, monkeypatch):
    """Rows that lie in one file of many train in parts of equal size, one a core at most."""
    from churnlens.operators import trees as T
    monkeypatch.setattr(T, "TASK_ROWS", (100, 1000))
    d = spark.range(0, 2000, numPartitions=6).where("id < 1000").select(F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 2).cast("int").alias("Left"))
    seen = []

    def fit(self, rows):
        seen.append([len(p) for p in rows.rdd.glom().collect()])

    monkeypatch.setattr(T.GBTClassifier, "fit", fit)
    T.gbt_fit(d, ["a", "b"])
    sizes = [n for n in seen[0] if n]
    assert sum(sizes) == 1000 and len(sizes) == min(10, spark.sparkContext.defaultParallelism) and max(sizes) <= 1.2 * min(sizes)


def test_folds_are_prepared_once_for_several_grids(spark):
    from churnlens.operators import trees as T
    d = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), F.rand(2).alias("b"), (F.col("id") % 2).cast("int").alias("Left"), (F.col("id") % 3).cast("int").alias("fold"))
    calls = []
    grid = dict(colsample=[1.0], learning_rate=[0.1], max_depth=[2], n_estimators=[2, 3], subsample=[1.0])
    parts = T.fold_parts(d, ["a", "b"], prepare=lambda a, b: calls.append(1) or (a, b, None))
    one, two = (T.gbt_grid(d, ["a", "b"], grid=grid, parts=parts).toPandas() for _ in range(2))
    assert len(calls) == 3 and one.equals(two) and one.equals(T.gbt_grid(d, ["a", "b"], grid=grid).toPandas())


def test_layers_are_searched_by_boxes(monkeypatch):
    """The neighbours in overlapping subsets of a table: all of them, from few distances."""
    g = np.random.default_rng(3)
    b = np.round(g.random((4000, 2)) * 100, 1)
    member = g.random((3, 4000)) < np.array([[0.2], [0.6], [1.0]])
    done, dist = [], K._dist
    monkeypatch.setattr(K, "_dist", lambda *a: done.append(len(a[0]) * len(a[1])) or dist(*a))
    got = {q: set(cols) for q, cols, _ in K._search_layers(b[:2000], np.full(2000, np.inf), b, member, 5, "manhattan", 1.0)}
    d = dist(b[:2000], b, "manhattan", 1.0)
    for q in range(0, 2000, 10):
        for m in member:
            near = np.flatnonzero(m)
            assert set(near[np.lexsort([near, np.round(d[q, near], 9)])[:5]]) <= got[q]
    assert sum(done) < 0.5 * d.size and max(map(len, got.values())) < 60


def test_learning_curve_in_cells(spark):
    from churnlens.operators import tuning as V
    g = np.random.default_rng(4)
    d = spark.createDataFrame(pd.DataFrame({"Customer_ID": range(160), "a": g.random(160), "b": g.integers(0, 4, 160).astype(float), "Left": g.integers(0, 2, 160), "fold": np.arange(160) % 3}))
    one, cells = (V.knn_learning_scores(d, ["a", "b"], 4, "distance", "manhattan", fractions=(0.1, 0.5, 1.0), block=n).toPandas() for n in (4096, 5))
    key = ["part", "fold", "train_size", "y", "score"]
    assert one.sort_values(key).reset_index(drop=True).equals(cells.sort_values(key).reset_index(drop=True))
