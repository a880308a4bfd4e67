"""Model search and what it rests on, against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnlens import session
from churnlens.operators import metrics as M
from churnlens.operators import mlp as N
from churnlens.operators import neighbors as K
from churnlens.operators import trees as T
from churnlens.operators import tuning as V
from churnlens.operators.rank import _bucketed, global_cumsum, global_rank

COLS = ["a", "b", "c"]


def table(n=400, seed=1):
    g = np.random.default_rng(seed)
    x = np.round(g.normal(size=(n, 3)), 3)
    y = (x[:, 0] - x[:, 1] ** 2 + 0.3 * g.normal(size=n) > -0.5).astype(int)
    return pd.DataFrame(x, columns=COLS).assign(Customer_ID=np.arange(n), Left=y, fold=np.arange(n) % 3)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table())


# ---- networks ------------------------------------------------------------------

def plain_loss(vec, shapes, x, y, act, alpha):
    layers, i = [], 0
    for s in shapes:
        n = int(np.prod(s))
        layers.append(vec[i:i + n].reshape(s))
        i += n
    a, cost = x, 0.0
    for li in range(0, len(layers), 2):
        z = a @ layers[li] + layers[li + 1]
        a = z if li == len(layers) - 2 else {"relu": lambda v: np.maximum(v, 0), "tanh": np.tanh, "logistic": lambda v: 1 / (1 + np.exp(-v))}[act](z)
        cost += 0.5 * alpha * (layers[li] ** 2).sum() / len(x)
    p = 1 / (1 + np.exp(-a[:, 0]))
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + cost


@pytest.mark.parametrize("act", ["relu", "tanh", "logistic"])
def test_gradients_of_many_networks(act):
    g = np.random.default_rng(3)
    x, y = g.normal(size=(30, 3)), (g.random(30) < 0.4).astype(float)
    spec = N.Spec((5, 4), act)
    flat = g.normal(size=(3, N.initial(spec, 3, 0).size))
    alpha, grad = np.array([0.0, 0.1, 1.0]), np.empty_like(flat)
    loss = N._gradients(x, y, N._layers(flat, spec.shapes(3)), act, alpha, N._layers(grad, spec.shapes(3)))
    for i in range(3):
        assert loss[i] == pytest.approx(plain_loss(flat[i], spec.shapes(3), x, y, act, alpha[i]))
        for at in g.integers(0, flat.shape[1], 12):
            step = np.zeros(flat.shape[1])
            step[at] = 1e-6
            d = (plain_loss(flat[i] + step, spec.shapes(3), x, y, act, alpha[i]) - plain_loss(flat[i] - step, spec.shapes(3), x, y, act, alpha[i])) / 2e-6
            assert grad[i, at] == pytest.approx(d, abs=1e-5)


def test_same_weights_under_any_read_split(spark, rows):
    """Several shards train; how the table is read or split among tasks changes nothing."""
    vecs = []
    for parts in (1, 5, 13):
        t = N.store_shards(rows.repartition(parts), COLS, shards=6)
        assert t.count() == 6 and t.where("n > 0").count() > 3
        vecs.append([s.vec for s in N.fit_many(t.repartition(parts), 3, [N.Spec((8,), "tanh", batch_size=16, learning_rate=0.01)], max_iter=4)][0])
    assert (vecs[0] == vecs[1]).all() and (vecs[0] == vecs[2]).all()


def test_trained_together_as_alone(spark, rows):
    t = N.store_shards(rows, COLS, fold_col="fold", shards=4)
    specs = [N.Spec((6,), a, al, lr, bs, f) for a in ("relu", "tanh") for al, lr, bs in ((0.0, 0.01, 16), (0.1, 0.003, 32)) for f in (-1, 0, 2)]
    together = N.fit_many(t, 3, specs, 6, True, 0.2)
    for i in (0, 4, 7, 11):
        alone = N.fit_many(t, 3, [specs[i]], 6, True, 0.2)[0]
        assert np.allclose(together[i].vec, alone.vec, atol=1e-6) and together[i].epochs == alone.epochs


def test_one_shard_is_plain_adam(spark, rows):
    """One shard, one batch an epoch: the textbook steps on the whole table."""
    pdf = table()
    x, y = pdf[COLS].to_numpy(np.float32), pdf["Left"].to_numpy(np.float32)
    spec = N.Spec((4,), "tanh", 0.01, 0.05, 1000)
    got = N.fit_many(N.store_shards(rows, COLS, shards=1), 3, [spec], 5)[0].vec
    w = N.initial(spec, 3, 17)[None].astype(np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 6):
        g = np.empty_like(w)
        N._gradients(x.astype(float), y.astype(float), N._layers(w, spec.shapes(3)), "tanh", np.array([0.01]), N._layers(g, spec.shapes(3)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose(got, w[0], atol=2e-3)


def test_clashing_names_and_bad_rows(spark):
    pdf = table(80).rename(columns={"a": "x", "b": "y", "c": "u"}).assign(shard=1, n=2, prob_=0.5)
    d = spark.createDataFrame(pdf)
    m = N.mlp_fit(d, ["x", "y", "u"], hidden=(3,), max_iter=2, shards=2)
    assert m.transform(d).where("prob between 0 and 1").count() == 80
    with pytest.raises(ValueError, match="missing"):
        N.store_shards(d.withColumn("x", F.when(F.col("Customer_ID") > 3, F.col("x"))), ["x", "y"])
    with pytest.raises(ValueError, match="more shards"):
        N.MAX_SHARD_ROWS, before = 10, N.MAX_SHARD_ROWS
        try:
            N.store_shards(d, ["x"], shards=2)
        finally:
            N.MAX_SHARD_ROWS = before


def test_early_stopping_and_learning(spark):
    d = spark.createDataFrame(table(1500, 5))
    m = N.mlp_fit(d, COLS, hidden=(16,), activation="tanh", learning_rate=0.01, batch_size=64, max_iter=200, early_stopping=True, validation_fraction=0.2, shards=3)
    assert 11 < m.epochs < 200 and max(m.history) == pytest.approx(max(m.history[:-10]), abs=1e-9)
    assert M.auc(m.transform(d), "prob", "Left").first()["auc"] > 0.85


def test_grid_refit_and_save(spark, tmp_path):
    d = spark.createDataFrame(table(600, 6))
    grid = dict(activation=["relu", "tanh"], alpha=[0.001], batch_size=[32], hidden=[(4,), (8, 4)], learning_rate=[1e-5, 0.02])
    r = N.mlp_grid(d, COLS, grid=grid, max_iter=30, shards=2)
    pdf = r.toPandas().sort_values("rank")
    assert len(pdf) == 8 and pdf["mean_auc"].is_monotonic_decreasing and pdf.iloc[0]["learning_rate"] == 0.02
    p = N.winner(r)
    m = N.mlp_fit(d, COLS, max_iter=30, early_stopping=True, shards=2, **p)
    m.write().overwrite().save(f"{tmp_path}/m")
    from churnlens.sources.io import load_model
    back = load_model(f"{tmp_path}/m")
    assert (back.vec == m.vec).all() and back.spec == m.spec and back.features == m.features
    a, b = (x.transform(d).select("Customer_ID", "prob", "margin").orderBy("Customer_ID").collect() for x in (m, back))
    assert a == b


def test_learning_networks_see_prefixes(spark, rows):
    sizes = V.fold_sizes(rows)
    d = V.fold_positions(rows, "Customer_ID", "fold", sorted(sizes))
    pdf = d.toPandas().sort_values("Customer_ID")
    for i, f in enumerate(sorted(sizes)):
        want = np.where(pdf["fold"] != f, np.cumsum(pdf["fold"] != f), 0)
        assert [p[i] for p in pdf["_pos"]] == want.tolist()
    s = N.mlp_learning_scores(d, COLS, [20, 100], [0, 1, 2], max_iter=3, hidden=(3,), shards=2)
    n = {(r["part"], r["fold"], r["train_size"]): r["count"] for r in s.groupBy("part", "fold", "train_size").count().collect()}
    assert n == {(p, f, k): (k if p == "train" else sizes[f]) for p in ("train", "validation") for f in range(3) for k in (20, 100)}


# ---- trees ----------------------------------------------------------------------

def test_stages_are_fits_of_fewer_trees(spark, rows):
    m = {k: T.gbt_fit(rows, COLS, max_depth=3, learning_rate=0.2, n_estimators=k, colsample=0.7, subsample=0.8) for k in (4, 9)}
    s = T.staged_scores(m[9], rows, COLS, [9, 4]).select("Customer_ID", "margins").toPandas().sort_values("Customer_ID")
    for i, k in enumerate((9, 4)):
        own = T.gbt_score(m[k], rows, COLS).select("Customer_ID", "margin").toPandas().sort_values("Customer_ID")
        assert np.allclose([x[i] for x in s["margins"]], own["margin"], atol=1e-9)
    imp = T.importances(m[9], COLS, spark).toPandas()
    assert imp["gain_share"].sum() == pytest.approx(1) and imp["summed_gain"].sum() == pytest.approx(1)
    assert set(imp["feature"]) == set(COLS) and imp["n_splits"].sum() > 9


def test_tree_grid_and_winner(spark, rows):
    grid = dict(colsample=[1.0], learning_rate=[0.1, 0.001], max_depth=[2], n_estimators=[2, 6], subsample=[1.0])
    assert len(T.staged_fits(grid)) == 2 and len(T.staged_fits(T.TUNING_GRID)) == 36
    r = T.gbt_grid(rows, COLS, grid=grid)
    pdf = r.toPandas().sort_values("point")
    assert pdf["rank"].sort_values().tolist() == [1, 2, 3, 4] and pdf["n_estimators"].tolist() == [2, 6, 2, 6]
    p = T.winner(r)
    best = pdf[pdf["rank"] == 1].iloc[0]
    auc = []
    for f in range(3):
        m = T.gbt_fit(rows.where(F.col("fold") != f), COLS, **p)
        auc.append(M.auc(T.gbt_score(m, rows.where(F.col("fold") == f), COLS).withColumn("margin", F.round("margin", 9)), "margin", "Left").first()["auc"])
    assert best["mean_auc"] == pytest.approx(np.mean(auc), abs=1e-9) and best["std_auc"] == pytest.approx(np.std(auc), abs=1e-8)


def test_fold_estimator_in_a_cross_validator(spark):
    """Scaling, SMOTE and weights are learned from the training part of each fold alone."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from churnlens.operators import folds as FO
    pdf = table(300, 8)
    pdf = pd.concat([pdf[pdf.Left == 1], pdf[pdf.Left == 0].head(40)])
    d = spark.createDataFrame(pdf.assign(label=pdf.Left.astype(float)))
    seen = []
    base = FO.prepared

    def spy(train, others, *a, **k):
        out = base(train, others, *a, **k)
        counts = {r["Left"]: r["count"] for r in out[0].groupBy("Left").count().collect()}
        seen.append((train.count(), counts[0], counts[1], out[2].stats["a"][0]))
        return out

    FO.prepared = spy
    try:
        lr = LogisticRegression()
        est = FO.FoldEstimator(lr, COLS, scale=True, resample="smote", weight="train", k=3)
        cv = CrossValidator(estimator=est, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, [0.0, 10.0]).build(),
                            evaluator=BinaryClassificationEvaluator(), foldCol="fold", numFolds=3)
        best = cv.fit(d)
    finally:
        FO.prepared = base
    assert len(seen) == 7 and all(n0 == n1 for _, n0, n1, _ in seen)
    assert len({round(m, 6) for *_, m in seen}) == 4  # three folds and the refit
    assert best.avgMetrics[0] >= best.avgMetrics[1] - 1e-9 and 0.5 < best.avgMetrics[0] <= 1
    out = best.bestModel.transform(d)
    assert set(d.columns) <= set(out.columns) and "features" not in out.columns and out.count() == d.count()
    assert FO.class_weight(d, "Left") == pytest.approx(40 / (len(pdf) - 40))


# ---- neighbours ------------------------------------------------------------------

def brute_neighbours(q, b, k, metric, apart=None, self_=False):
    out = {}
    for i, r in q.iterrows():
        diff = b[COLS].to_numpy() - r[COLS].to_numpy(dtype=float)
        d = np.sqrt((diff ** 2).sum(1)) if metric == "euclidean" else np.abs(diff).sum(1)
        ok = [j for j in range(len(b)) if not (apart and b["fold"].iloc[j] == r["fold"]) and not (self_ and b["Customer_ID"].iloc[j] == r["Customer_ID"])]
        out[int(r["Customer_ID"])] = [int(b["Customer_ID"].iloc[j]) for j in sorted(ok, key=lambda j: (round(d[j], 9), b["Customer_ID"].iloc[j]))[:k]]
    return out


def found(df):
    pdf = df.toPandas().sort_values(["qid", "rank"])
    return {int(q): g["nid"].astype(int).tolist() for q, g in pdf.groupby("qid")}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("block", [16, 64, 5000])
def test_pivots_are_exact(spark, metric, block):
    g = np.random.default_rng(4)
    pdf = table(260, 9)
    pdf[COLS] = pdf[COLS].round(1) + 4 * g.integers(0, 4, (260, 1))      # clusters, and many ties
    d = spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(K.knn_topk(d, d, COLS, 6, metric, block=block, exclude_self=True)) == brute_neighbours(pdf, pdf, 6, metric, self_=True)
        assert found(K.knn_topk(d, d, COLS, 6, metric, block=block, apart="fold")) == brute_neighbours(pdf, pdf, 6, metric, apart=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_far_pivots_are_not_sent(spark):
    """Two clusters far apart: a query's second round does not visit the other one."""
    g = np.random.default_rng(5)
    x = np.round(g.normal(size=(200, 3)), 3) + 1000 * (np.arange(200)[:, None] % 2)
    pivots = K._Pivots(x[:8], "euclidean", 2.0)
    home = pivots.distances(x).argmin(axis=1)
    for c in range(8):
        pivots.radius[c], pivots.count[c] = pivots.distances(x)[home == c, c].max(), (home == c).sum()
    q = spark.createDataFrame([(i, x[i].tolist(), -1, 5.0) for i in range(200)], "qid long, v array<double>, _g int, tau double")
    first = K._visits(q.drop("tau"), pivots, 5, False).select("qid", "c").collect()
    second = K._visits(q, pivots, 5, True).select("qid", "c").collect()
    both = first + second
    assert len(both) == len(set(both)) and len(second) > 0
    assert all(r["qid"] % 2 == r["c"] % 2 for r in both)


def test_identical_points(spark):
    """10,000 equal rows: a tile gives k rows a query, and the smallest keys win."""
    b = spark.range(10_000).select(F.col("id").alias("Customer_ID"), *[F.lit(1.0).alias(c) for c in COLS])
    q = b.where("Customer_ID < 20").withColumn("a", F.lit(0.5))
    assert len(K._best(np.ones((3, 4000)), 5)[0]) == 15
    assert found(K.knn_topk(q, b, COLS, 7)) == {i: list(range(7)) for i in range(20)}
    assert found(K.knn_topk(q, b.limit(0), COLS, 7)) == {}
    assert found(K.knn_topk(q, b.limit(3), COLS, 7)).keys() == set(range(20))


def test_approximate_neighbours(spark):
    pdf = table(800, 11)
    d = spark.createDataFrame(pdf)
    near, exact = found(K.knn_approx(d, d, COLS, 5, exclude_self=True)), brute_neighbours(pdf, pdf, 5, "euclidean", self_=True)
    assert sum(len(set(near.get(i, [])) & set(x)) for i, x in exact.items()) >= 0.9 * 5 * 800
    assert K.knn_approx(d.limit(0), d, COLS, 5).count() == 0


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_learning_curve_in_tiles(spark, weights):
    pdf = table(90, 12)
    pdf[COLS] = pdf[COLS].round(0)
    d = spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # tiles lie in partitions of their own
    try:
        s = V.knn_learning_scores(d, COLS, 4, weights, "manhattan", fractions=(0.2, 1.0), block=25, base_block=40).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for f in range(3):
        tr = pdf[pdf.fold != f]
        for n in V.train_sizes({k: int((pdf.fold == k).sum()) for k in range(3)}, (0.2, 1.0)):
            sub = tr.head(n)
            for part, rows_ in (("train", sub), ("validation", pdf[pdf.fold == f])):
                want = []
                for i, near in brute_neighbours(rows_, sub, 4, "manhattan").items():
                    b = sub.set_index("Customer_ID").loc[near]
                    dist = np.abs(b[COLS].to_numpy() - pdf.set_index("Customer_ID").loc[i, COLS].to_numpy(dtype=float)).sum(1)
                    w = np.ones(len(near)) if weights == "uniform" else (dist == 0).astype(float) if (dist == 0).any() else 1 / dist
                    want.append((int(pdf["Left"][i]), round(float((w * b["Left"].to_numpy()).sum() / w.sum()), 6)))
                got = s[(s.part == part) & (s.fold == f) & (s.train_size == n)]
                assert sorted(zip(got["y"], got["score"].round(6))) == sorted(want)
                total += len(want)
    assert total == len(s)


# ---- metrics, ranks, attributions, memory ---------------------------------------

def test_curve_metrics_agree_with_the_single_ones(spark):
    g = np.random.default_rng(13)
    pdf = pd.DataFrame({"m": np.arange(600) % 4, "s": g.integers(0, 12, 600) / 10, "y": g.integers(0, 2, 600)})
    pdf.loc[pdf.m == 2, "y"] = 1                                   # one class only
    pdf.loc[pdf.m == 3, "s"] = -pdf["y"].astype(float)             # no threshold is better than none
    d = spark.createDataFrame(pdf)
    rows = {r["m"]: r for r in M.curve_metrics(d, "s", "y", ["m"]).collect()}
    for m in range(4):
        own = d.where(F.col("m") == m)
        y, a = M.youden(own, "s", "y").first(), M.auc(own, "s", "y").first()["auc"]
        c = M.metrics_from_counts(M.confusion_counts(own, "y", M.apply_threshold(F.col("s"), F.lit(y["threshold"])))).first()
        assert rows[m]["threshold"] == y["threshold"] and rows[m]["auc"] == a
        assert [rows[m][k] for k in ("tp", "fp", "fn", "tn", "accuracy", "recall", "precision", "f1")] == [c[k] for k in ("tp", "fp", "fn", "tn", "accuracy", "recall", "precision", "f1")]
    assert rows[3]["threshold"] == float("inf") and rows[2]["auc"] is None


@pytest.mark.parametrize("descending", [False, True])
def test_frequent_first_value_is_split(spark, descending):
    """90 % equal first values: buckets follow the second column, and none is far above the median."""
    g = np.random.default_rng(14)
    n = 4000
    first = [None if v < 0.3 else 5.0 if v < 0.93 else float(g.integers(0, 50)) for v in g.random(n)]
    second = [None if v < 0.05 else float("nan") if v < 0.1 else float(g.integers(0, 300)) for v in g.random(n)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(first, second))], "id long, a double, b double")
    sizes = [r["count"] for r in _bucketed(d, ["a", "b", "id"], 20, descending, None).groupBy("_bk").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * n / 20 * 1.2
    key = lambda r: tuple((x is not None, (x != x) if x is not None else False, 0.0 if x is None or x != x else x) for x in (r["a"], r["b"])) + (r["id"],)
    got = global_rank(d, ["a", "b", "id"], descending=descending, n_buckets=20, out="r").orderBy("r").collect()
    assert [r["r"] for r in got] == list(range(1, n + 1))
    assert [r["id"] for r in got] == [r["id"] for r in sorted(d.collect(), key=key, reverse=descending)]
    c = global_cumsum(d.withColumn("one", F.lit(1)), ["a", "b", "id"], ["one"], descending=descending, n_buckets=20).orderBy("cum_one").collect()
    assert [r["id"] for r in c] == [r["id"] for r in got]


def test_sampled_shapley(spark):
    from churnlens.operators.explain import shapley, shapley_sampled
    g = np.random.default_rng(15)
    names = [f"f{i}" for i in range(7)]
    d = spark.createDataFrame(pd.DataFrame(g.normal(size=(12, 7)), columns=names).assign(Customer_ID=np.arange(12)))

    def score(x):
        return x.withColumn("margin", 2 * F.col("f0") - F.col("f1") * F.col("f2") + F.sin("f3") * F.col("f4") + F.col("f5") ** 2)

    exact = shapley(score, d, d.limit(6), names).toPandas().set_index(["Customer_ID", "feature"])
    s = shapley_sampled(score, d, d.limit(6), names, rounds=12).toPandas().set_index(["Customer_ID", "feature"]).loc[exact.index]
    off = np.abs(s["phi"] - exact["phi"])
    assert (off <= 3 * s["se"] + 1e-9).mean() > 0.98
    assert (s["se"] > 0).any() and np.allclose(s["base_value"], exact["base_value"])
    sums = s.groupby("Customer_ID").agg(t=("phi", "sum"), b=("base_value", "first"), m=("margin", "first"))
    assert np.allclose(sums["t"] + sums["b"], sums["m"])
    many = [f"g{i}" for i in range(18)]
    wide = spark.createDataFrame(pd.DataFrame(g.normal(size=(5, 18)), columns=many).assign(Customer_ID=np.arange(5)))
    w = shapley_sampled(lambda x: x.withColumn("margin", sum((F.col(c) for c in many), F.lit(0.0))), wide, wide.limit(3), many).toPandas()
    base = wide.limit(3).toPandas()[many].mean()
    x = wide.toPandas().set_index("Customer_ID")
    assert np.allclose(w["phi"], [x.loc[i, f] - base[f] for i, f in zip(w["Customer_ID"], w["feature"])])


def test_permutation_importance_finds_the_feature(spark, rows):
    r = V.permutation_importance(lambda d: d.withColumn("prob", F.when(F.col("a") > 0, 0.9).otherwise(0.1)), rows, COLS, repeats=3).toPandas().set_index("feature")
    assert r.loc["a", "importance_mean"] > 0.1 and r.loc["b", "importance_mean"] == 0 and r.loc["c", "importance_std"] == 0


def test_stored_tables_follow_the_input(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.range(3).write.parquet(f"{path}/t.parquet")
    make = lambda: spark.read.parquet(f"{path}/t.parquet")
    key = session.inputs_key(spark, path)
    assert session.stored(spark, "x", key, make).count() == 3 and session.inputs_key(spark, path) == key
    spark.range(5).write.mode("overwrite").parquet(f"{path}/t.parquet")
    assert session.stored(spark, "x", session.inputs_key(spark, path), make).count() == 5
    assert session.stored(spark, "x", key, make).count() == 3


def test_outlier_rows(spark):
    from churnlens.operators.profile import box_outliers, box_stats
    d = spark.createDataFrame([(i, i % 2, float(v)) for i, v in enumerate([1, 1, 2, 2, 3, 3, 50, 4, None or 5, -90])], "Customer_ID long, g int, v double")
    rows_ = box_outliers(d, "v", "g").collect()
    assert {(r["g"], r["v"]) for r in rows_} == {(0, 50.0), (1, -90.0)}
    assert sum(r["n_outliers"] for r in box_stats(d, "v", "g").collect()) == len(rows_)
    assert {r["v"] for r in box_outliers(d, "v").collect()} == {50.0, -90.0}
