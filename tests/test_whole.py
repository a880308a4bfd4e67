"""The whole job: grids of trees with all their points, shards for tables of any size, all importances."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnlens.operators import boosting as B
from churnlens.operators import metrics as M
from churnlens.operators import mlp as N
from churnlens.operators import trees as T
from churnlens.plans import model_queries as Q
from churnlens.plans import search_queries as S

COLS = ["a", "b", "c"]


def table(n=300, seed=1):
    g = np.random.default_rng(seed)
    x = np.round(g.normal(size=(n, 3)), 2)
    y = (x[:, 0] - x[:, 1] ** 2 + 0.3 * g.normal(size=n) > -0.5).astype(int)
    return pd.DataFrame(x, columns=COLS).assign(Customer_ID=np.arange(n), Left=y, fold=np.arange(n) % 3)


# ---- grids of trees --------------------------------------------------------------

class _Asked(Exception):
    pass


def asked_points(monkeypatch, query):
    """The grids that a query searches."""
    seen = []

    def grid(*a, grid=None, **k):
        seen.append(grid or T.TUNING_GRID)
        raise _Asked

    monkeypatch.setattr(T, "gbt_grid", grid)
    monkeypatch.setattr(S, "train_folds", lambda *a, **k: None)
    monkeypatch.setattr(S, "stored", lambda spark, name, key, make: make())
    monkeypatch.setattr(S, "inputs_key", lambda *a: ())
    with pytest.raises(_Asked):
        query(None, "")
    return seen


def test_tuning_asks_for_every_point(monkeypatch):
    for q in (S.q_grid_search_gbt, S._gbt_grid):
        assert [int(np.prod([len(v) for v in g.values()])) for g in asked_points(monkeypatch, q)] == [108]


def test_tuned_trees_come_from_the_whole_grid(spark, monkeypatch):
    rows = spark.createDataFrame(table()).select("Left", *COLS)
    monkeypatch.setattr(S, "train_test", lambda *a, **k: (rows, rows))
    monkeypatch.setattr(T, "gbt_fit", lambda *a, **k: None)
    assert asked_points(monkeypatch, S.q_gbt_tuned_against_basic) == [T.TUNING_GRID]


def test_rebalancing_asks_for_every_point(spark, monkeypatch):
    rows = spark.createDataFrame(table()).select("Left", *COLS)
    monkeypatch.setattr(S, "train_test", lambda *a, **k: (rows, rows))
    monkeypatch.setattr(S, "_balanced", lambda *a, **k: rows)
    monkeypatch.setattr(T, "fold_parts", lambda *a, **k: {})
    monkeypatch.setattr(T, "gbt_fit", lambda *a, **k: None)
    monkeypatch.setattr(T, "gbt_score", lambda m, d, f: d.withColumn("prob", F.lit(0.5)))
    grids = asked_points(monkeypatch, S.q_experiment_trees)
    assert grids == [T.REBALANCING_GRID] and int(np.prod([len(v) for v in grids[0].values()])) == 162


@pytest.mark.parametrize("kw", [dict(max_depth=3, colsample=0.6), dict(max_depth=4, subsample=0.7, colsample=1.0), dict(max_depth=3, subsample=0.9, colsample=0.5, weight=2.5)])
def test_grown_in_a_task_as_by_spark(spark, kw):
    """The same margins as from ``GBTClassifier`` on the same rows in one partition."""
    kw = dict(kw)
    weight = kw.pop("weight", None)
    d = T.written(spark.createDataFrame(table(500, 4)).coalesce(1), "rows")
    pdf = d.toPandas()
    x, y = pdf[COLS].to_numpy(), pdf["Left"].to_numpy()
    m = T.gbt_fit(d, COLS, learning_rate=0.2, n_estimators=5, pos_weight=weight, deal=False, **kw)
    want = T.staged_scores(m, d, COLS, [2, 5]).select("Customer_ID", "margins").toPandas().set_index("Customer_ID")["margins"]
    cuts = [B.thresholds(x[:, j], np.where(y == 1, weight, 1.0) if weight else None) for j in range(3)]
    bins = B.binned(x, cuts)
    got = B.staged_margins(np.concatenate([bins, bins], axis=1), np.array([len(c) for c in cuts]), y, len(y), [2, 5], learning_rate=0.2, pos_weight=weight, **kw)
    assert np.allclose(got.T, np.stack(want.loc[pdf["Customer_ID"]]), atol=1e-9)


def test_grid_is_the_same_grown_in_tasks_or_by_jobs(spark, monkeypatch):
    """Every point, whichever way its ensembles are grown; one class alone in a fold has no AUC."""
    d = spark.createDataFrame(table(240, 2).assign(b=lambda p: p["b"].round(1)))
    grid = dict(colsample=[0.7, 1.0], learning_rate=[0.1, 0.3], max_depth=[2, 3], n_estimators=[2, 4], subsample=[1.0])
    parts = T.fold_parts(d, COLS)
    parts = {f: (a, b, 1.7) for f, (a, b, _) in parts.items()}
    tasks = T.gbt_grid(d, COLS, grid=grid, parts=parts).orderBy("point").toPandas()
    monkeypatch.setattr(T, "TASK_ROWS", (16_384, 0))
    jobs = T.gbt_grid(d, COLS, grid=grid, parts=parts).orderBy("point").toPandas()
    assert len(tasks) == 16 and np.allclose(tasks["mean_auc"], jobs["mean_auc"], atol=1e-9) and np.allclose(tasks["std_auc"], jobs["std_auc"], atol=1e-8)
    monkeypatch.undo()
    scores = T.grown_scores(parts, COLS, "Left", T.staged_fits(grid), [2, 4])
    assert scores.groupBy("fit", "fold", "stage").count().where("count = 80").count() == 8 * 3 * 2
    assert M.auc_by(scores, "score", "y", ["fit", "stage", "fold"]).count() == 48
    with pytest.raises(ValueError, match="missing"):
        T.gbt_grid(d.withColumn("a", F.when(F.col("Customer_ID") > 3, F.col("a"))), COLS, grid=grid)


# ---- networks of large tables ----------------------------------------------------

def test_large_tables_get_more_shards(spark, monkeypatch):
    """More rows than the default shards may hold, and one key for a third of them: every row is packed, and the networks train."""
    monkeypatch.setattr(N, "MAX_SHARD_ROWS", 30)
    pdf = table().assign(r=np.arange(1, 301))
    pdf.loc[pdf.index % 3 == 1, "Customer_ID"] = 7
    d = spark.createDataFrame(pdf)
    t = N.store_shards(d, COLS, fold_col="fold", shards=2, grow=True)
    sizes = [r["n"] for r in t.select("n").collect()]
    assert sum(sizes) == 300 and max(sizes) <= 30
    with pytest.raises(ValueError, match="more shards"):
        N.store_shards(d, COLS, shards=2)
    assert N.mlp_fit(d, COLS, hidden=(3,), max_iter=2, shards=2).transform(d).where("prob between 0 and 1").count() == 300
    s = N.mlp_cv_scores(d, COLS, max_iter=2, hidden=(3,), shards=2)
    assert s.groupBy("fold").count().orderBy("fold").collect() == [(f, 100) for f in range(3)]
    pos = d.withColumn("_pos", F.array(*[F.when(F.col("fold") != f, F.col("r")).otherwise(0) for f in range(3)]))
    s = N.mlp_learning_scores(pos, COLS, [50], [0, 1, 2], max_iter=2, hidden=(3,), shards=2)
    assert s.where("part = 'validation'").count() == 300


def test_few_rows_keep_their_shards(spark):
    """Tables that fit are dealt as they were."""
    d = spark.createDataFrame(table())
    a, b = (N.store_shards(d, COLS, shards=3, grow=g).orderBy("shard").collect() for g in (False, True))
    assert a == b and len(a) == 3


def test_driver_keeps_no_state_of_past_epochs(spark, monkeypatch):
    """The broadcast of an epoch is destroyed, and the best weights are no view of a whole state."""
    from pyspark.core.broadcast import Broadcast
    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **k: gone.append(1) or destroy(self, *a, **k))
    t = N.store_shards(spark.createDataFrame(table(120)), COLS, shards=2)
    s = N.fit_many(t, 3, [N.Spec((4,), "tanh", learning_rate=0.01, batch_size=16)], 3, True, 0.2)[0]
    assert len(gone) == 4 and s.vec.base is None


# ---- importances ----------------------------------------------------------------

def test_report_lists_every_importance(spark, monkeypatch):
    """The report on the derived features has all 18 importances."""
    g = np.random.default_rng(3)
    pdf = pd.DataFrame(g.normal(size=(60, 18)), columns=Q.ALL_FEATURES).assign(Left=np.arange(60) % 2)
    m = T.gbt_fit(spark.createDataFrame(pdf), Q.ALL_FEATURES, n_estimators=2)
    board = spark.createDataFrame([("KNN", 0, 0.7, 0.5, 1), ("Boosted trees", 1, 0.6, 0.5, 0)], "approach string, pos int, auc double, threshold double, is_best int")
    monkeypatch.setattr(Q, "_board", lambda *a, **k: board)
    monkeypatch.setattr(Q, "gbt", lambda *a, **k: (m, None))
    r = Q.q_final_report_engineered(spark, "").where("section = 'tree_importance'").collect()
    assert {x["name"] for x in r} == set(Q.ALL_FEATURES) and abs(sum(x["value"] for x in r) - 1) < 1e-9
