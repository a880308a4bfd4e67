"""Queries for phases 6-10: inference, trees, networks, explanation, reports.

Results that depend on iterative solvers or model training have no SQL; they
are checked by local tests (Newton fit, pairwise AUC, efficiency of Shapley
sums, AUC floors). What can be expressed (a network's gradient step, the
stages of a planted tree, a saved model's scores) has a DuckDB oracle. A model
is fitted once per session and input files, whatever queries read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnlens.operators import logit as L
from churnlens.operators import mlp as N
from churnlens.operators import prepare as X
from churnlens.operators import report as R
from churnlens.operators import trees as T
from churnlens.operators import tuning as V
from churnlens.operators.explain import background_sample, shapley, shapley_sampled, shapley_summary
from churnlens.operators.folds import class_weight
from churnlens.plans.clean_queries import clean
from churnlens.plans.model_prep_queries import _QUOTA_CTE, _scale_sql, scaled_split, split_df
from churnlens.plans.oracle_sql import CLEAN, FEATURES, with_
from churnlens.plans.registry import register
from churnlens.session import inputs_key, once, scratch_path, stored
from churnlens.sources.io import load_model, save_model

MONEY = {"Salary": 2, "Balance": 2}
# The reference's tuned kNN and MLP.
KNN_BEST = dict(k=33, weights="distance", metric="manhattan")
MLP_BEST = dict(hidden=(64, 32), activation="tanh", alpha=0.1, learning_rate=0.01, batch_size=256, max_iter=1000,
                early_stopping=True, validation_fraction=0.2)


@register("logit_inference")
def q_logit_inference(spark, sf):
    return L.logit_inference(clean(spark, sf), FEATURES, "Left", decimals=MONEY)


@register("logit_summary")
def q_logit_summary(spark, sf):
    return L.logit_summary(clean(spark, sf), FEATURES, "Left", decimals=MONEY)


@register("effect_text")
def q_effect_text(spark, sf):
    return L.effect_text(L.logit_inference(clean(spark, sf), FEATURES, "Left", decimals=MONEY))


@register("odds_ratio_top")
def q_odds_ratio_top(spark, sf):
    return L.odds_ratio_order(L.logit_inference(clean(spark, sf), FEATURES, "Left", decimals=MONEY), 10, "asc")


@register("logit_fit")
def q_logit_fit(spark, sf):
    m = L.logit_fit(clean(spark, sf), FEATURES, "Left", decimals=MONEY)
    rows = [(f, float(c)) for f, c in zip(FEATURES, m.coefficients)] + [("const", float(m.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def train_test(spark, sf, engineered=False, scaled=False):
    """Training and test rows: the clean split, with the derived columns if asked for, scaled by the training rows if asked for."""
    if scaled and not engineered:
        s = scaled_split(spark, sf)
    elif engineered:
        def make():
            s = X.engineer_features(split_df(spark, sf), on_zero="drop")
            return X.fit_scaler(s.where("is_test = 0"), ALL_FEATURES, MONEY).transform(s) if scaled else s

        s = stored(spark, f"engineered-{scaled}", inputs_key(spark, sf), make)
    else:
        s = stored(spark, "split", inputs_key(spark, sf), lambda: split_df(spark, sf))
    return s.where("is_test = 0"), s.where("is_test = 1")


ALL_FEATURES = [*FEATURES, *X.ENGINEERED]


def _features(engineered):
    return ALL_FEATURES if engineered else FEATURES


def gbt(spark, sf, engineered=False):
    """The tuned trees, the class weight taken over all rows as the reference does."""
    def fit():
        tr, te = train_test(spark, sf, engineered)
        return T.gbt_fit(tr, _features(engineered), "Left", pos_weight=class_weight(tr.unionByName(te), "Left"), seed=17, **T.BEST)

    return once(spark, f"gbt-{engineered}", inputs_key(spark, sf), fit), train_test(spark, sf, engineered)[1]


def mlp(spark, sf, engineered=False):
    """The tuned network on scaled features."""
    tr, te = train_test(spark, sf, engineered, scaled=True)
    return once(spark, f"mlp-{engineered}", inputs_key(spark, sf), lambda: N.mlp_fit(tr, _features(engineered), "Left", seed=17, **MLP_BEST)), tr, te


def knn_scores(spark, sf, k, weights, metric, engineered=False):
    tr, te = train_test(spark, sf, engineered, scaled=True)
    return V.knn_fit_score(k, weights, metric, _features(engineered))(tr, te)


@register("gbt_test_metrics")
def q_gbt_test_metrics(spark, sf):
    m, te = gbt(spark, sf)
    return R.approach_metrics(T.gbt_score(m, te, FEATURES), "Boosted trees", "prob", "Left")


@register("tree_importance")
def q_tree_importance(spark, sf):
    return T.tree_importance(gbt(spark, sf)[0], FEATURES, spark)


@register("tree_importance_gain")
def q_tree_importance_gain(spark, sf):
    """V6 in both counts: Spark's summed gain and the average gain of a split."""
    return T.importances(gbt(spark, sf)[0], FEATURES, spark)


def _stump(spark, sf):
    """A depth-1 tree on one planted split: class 1 exactly for ages over 50, and two columns of noise."""
    d = clean(spark, sf).select("Customer_ID", F.col("Age").cast("double").alias("Age"), F.col("Score").cast("double").alias("Score"),
                                (F.col("Age") > 50).cast("int").alias("y"))
    m = once(spark, "stump", inputs_key(spark, sf), lambda: T.gbt_fit(d, ["Score", "Age"], "y", max_depth=1, learning_rate=0.5, n_estimators=3, colsample=1.0, seed=17))
    return m, d


# the first tree fits +1 / -1; each later one fits the negative gradient of 2 log(1 + exp(-2 y F)), whose sign is that of y:
# 4 y / (1 + exp(2 y F)), the same for all rows of a side; the log-odds are 2 F
_STAGES = with_(CLEAN, """
SELECT Customer_ID, stage, ROUND(CASE WHEN Age > 50 THEN 2 * f ELSE -2 * f END, 9) AS margin FROM clean,
     (SELECT 1 AS stage, 1.0 AS f
      UNION ALL SELECT 2, 1.0 + 0.5 * 4 / (1 + exp(2.0))
      UNION ALL SELECT 3, 1.0 + 0.5 * 4 / (1 + exp(2.0)) + 0.5 * 4 / (1 + exp(2 * (1.0 + 0.5 * 4 / (1 + exp(2.0))))))""")


@register("staged_scores", _STAGES)
def q_staged_scores(spark, sf):
    """The log-odds after 1, 2 and 3 trees of a planted stump, from one fit and one pass."""
    m, d = _stump(spark, sf)
    s = T.staged_scores(m, d, ["Score", "Age"], [1, 2, 3]).select("Customer_ID", F.posexplode("margins").alias("stage", "margin"))
    return s.select("Customer_ID", (F.col("stage") + 1).alias("stage"), F.round("margin", 9).alias("margin"))


@register("stump_gain", with_(CLEAN, """
SELECT 'Age' AS feature, CAST(3 AS BIGINT) AS n_splits, CAST(1 AS DOUBLE) AS importance
UNION ALL SELECT 'Score', CAST(0 AS BIGINT), CAST(0 AS DOUBLE)"""))
def q_stump_gain(spark, sf):
    """V6 on the planted stump: every split is on the age."""
    g = T.split_gain(T.node_table(_stump(spark, sf)[0]), ["Score", "Age"])
    return g.select("feature", F.col("n_splits").cast("bigint").alias("n_splits"), F.round("importance", 9).alias("importance"))


@register("shapley")
def q_shapley(spark, sf):
    def make():
        m, te = gbt(spark, sf)
        return shapley(lambda d: T.gbt_score(m, d, FEATURES), te, background_sample(te), FEATURES, trees=T.StagedTrees(T.node_table(m)))

    return stored(spark, "shapley", inputs_key(spark, sf), make)      # once for both queries


@register("shapley_summary")
def q_shapley_summary(spark, sf):
    return shapley_summary(q_shapley(spark, sf))


@register("shapley_engineered")
def q_shapley_engineered(spark, sf):
    """V7 beyond ten features: sampled attributions with standard errors for the trees on all 18."""
    m, te = gbt(spark, sf, engineered=True)
    return shapley_sampled(lambda d: T.gbt_score(m, d, ALL_FEATURES), te, background_sample(te, 20), ALL_FEATURES, trees=T.StagedTrees(T.node_table(m)))


@register("mlp_test_metrics")
def q_mlp_test_metrics(spark, sf):
    m, _, te = mlp(spark, sf)
    return R.approach_metrics(m.transform(te), "NeuralNet", "prob", "Left")


@register("train_accuracy")
def q_train_accuracy(spark, sf):
    m, tr, _ = mlp(spark, sf)
    s = m.transform(tr)
    return s.agg(F.avg(F.when((F.col("prob") > 0.5).cast("int") == F.col("Left"), 1.0).otherwise(0.0))
                 .alias("train_accuracy"))


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    m, _, te = mlp(spark, sf)
    return V.permutation_importance(m.transform, te.select("Customer_ID", "Left", *FEATURES), FEATURES, "Left",
                                    repeats=10, seed=17)


# ---- one step of a small network, in SQL ---------------------------------------

_HID, _ALPHA, _RATE = 3, 0.1, 0.01


def _planted_weight(layer, i, j):
    """Weights of a network that both engines can write down."""
    return ((7 * layer + 3 * i + 5 * j + 2) % 11 - 5) / 10


def _step_sql():
    w = _planted_weight
    h = ", ".join("tanh(" + " + ".join(f"{c} * ({w(0, i, j)})" for i, c in enumerate(FEATURES)) + f" + ({w(0, -1, j)})) AS h{j}" for j in range(_HID))
    z = " + ".join(f"h{j} * ({w(1, j, 0)})" for j in range(_HID)) + f" + ({w(1, -1, 0)})"
    rows = []
    for j in range(_HID):
        back = f"delta * ({w(1, j, 0)}) * (1 - h{j} * h{j})"
        rows += [(0, i, j, w(0, i, j), f"SUM({back} * {c})") for i, c in enumerate(FEATURES)] + [(0, -1, j, w(0, -1, j), f"SUM({back})")]
        rows.append((1, j, 0, w(1, j, 0), f"SUM(delta * h{j})"))
    rows.append((1, -1, 0, w(1, -1, 0), "SUM(delta)"))
    root = "sqrt(1 - 0.999)"
    body = "\nUNION ALL ".join(
        f"SELECT {la} AS layer, {i} AS i, {j} AS j, CAST({x} AS DOUBLE) AS weight, ROUND(({g} + {_ALPHA * x if i >= 0 else 0.0}) / COUNT(*), 9) AS gradient FROM dl"
        for la, i, j, x, g in rows)
    sql = _scale_sql()
    ctes, cols = sql[len("WITH "):].split("\nSELECT Customer_ID, \"Left\", is_test,", 1)
    return with_(ctes + f""",
sc AS (SELECT Customer_ID, "Left", is_test,{cols}),
hd AS (SELECT "Left", {', '.join(FEATURES)}, {h} FROM sc WHERE is_test = 0),
dl AS (SELECT *, 1 / (1 + exp(-({z}))) - "Left" AS delta FROM hd),
gr AS ({body})""", f"""SELECT layer, i, j, weight, gradient,
       ROUND(weight - {_RATE} * {root} * gradient / ({root} * abs(gradient) + 1e-8), 9) AS stepped FROM gr""")


@register("mlp_gradient_step", _step_sql())
def q_mlp_gradient_step(spark, sf):
    """One full-batch step from given weights: the gradient summed over the stored shards, and Adam's first step."""
    spec = N.Spec((_HID,), "tanh", _ALPHA, _RATE)
    vec = [_planted_weight(la, i, j) for la, (fi, fo) in enumerate([(len(FEATURES), _HID), (_HID, 1)]) for i in [*range(fi), -1] for j in range(fo)]
    tr, _ = train_test(spark, sf, scaled=True)
    return N.full_batch_step(N.store_shards(tr, FEATURES, "Left"), N.MLPModel(vec, spec, FEATURES))


@register("model_round_trip", with_(CLEAN + _QUOTA_CTE, """
SELECT m.model, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) AS BIGINT) AS n_equal
FROM split, (SELECT 'Boosted trees' AS model UNION ALL SELECT 'NeuralNet') m WHERE is_test = 1 GROUP BY m.model"""))
def q_model_round_trip(spark, sf):
    """S3: both models saved, loaded and scored again; every score is the same."""
    g, te = gbt(spark, sf)
    m, _, scaled = mlp(spark, sf)
    out = None
    for name, model, rows, score in (("Boosted trees", g, te, lambda x, d: T.gbt_score(x, d, FEATURES)), ("NeuralNet", m, scaled, lambda x, d: x.transform(d))):
        path = save_model(model, scratch_path(spark, f"model-{uuid.uuid4().hex}"))
        a = score(model, rows).select("Customer_ID", F.col("prob").alias("a"))
        j = a.join(score(load_model(path), rows).select("Customer_ID", F.col("prob").alias("b")), "Customer_ID")
        r = j.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") == F.col("b")).cast("bigint")).alias("n_equal")).select(F.lit(name).alias("model"), "n", "n_equal")
        out = r if out is None else out.unionByName(r)
    return out


# ---- reports -------------------------------------------------------------------

def _board(spark, sf, engineered=False):
    g, te = gbt(spark, sf, engineered)
    m, _, te2 = mlp(spark, sf, engineered)
    knn = R.approach_metrics(knn_scores(spark, sf, KNN_BEST["k"], KNN_BEST["weights"], KNN_BEST["metric"], engineered), "KNN", "proba", "Left", 0)
    trees = R.approach_metrics(T.gbt_score(g, te, _features(engineered)), "Boosted trees", "prob", "Left", 1)
    return R.leaderboard(knn.unionByName(trees).unionByName(R.approach_metrics(m.transform(te2), "NeuralNet", "prob", "Left", 2)))


def _board_rows(board, section):
    return board.select(F.lit(section).alias("section"), F.col("approach").alias("name"),
                        F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in ("auc", "threshold", "is_best")])).alias("s")) \
        .select("section", "name", "s.key", "s.value")


@register("final_report")
def q_final_report(spark, sf):
    """Test metrics per model, the best by AUC, and tree importances."""
    rows = _board_rows(_board(spark, sf), "model")
    imp = T.tree_importance(gbt(spark, sf)[0], FEATURES, spark).select(F.lit("tree_importance").alias("section"), F.col("feature").alias("name"),
                                                                       F.lit("importance").alias("key"), F.col("importance").alias("value"))
    return rows.unionByName(imp)


@register("final_report_engineered")
def q_final_report_engineered(spark, sf):
    """The three models on the original and on the derived features, the better set of each, and the importances of all 18."""
    a, b = _board(spark, sf), _board(spark, sf, engineered=True)
    rows = _board_rows(a, "original").unionByName(_board_rows(b, "engineered"))
    both = a.select("approach", "pos", F.col("auc").alias("o")).join(b.select("approach", F.col("auc").alias("e")), "approach")
    gain = both.select(F.lit("engineered less original").alias("section"), F.col("approach").alias("name"), F.lit("auc").alias("key"), (F.col("e") - F.col("o")).alias("value"))
    best = R.best_by(b.select("approach", "pos", "auc")).select(F.lit("best").alias("section"), F.col("approach").alias("name"), F.lit("auc").alias("key"), F.col("auc").alias("value"))
    imp = T.importances(gbt(spark, sf, engineered=True)[0], ALL_FEATURES, spark).select(
        F.lit("tree_importance").alias("section"), F.col("feature").alias("name"), F.lit("gain_share").alias("key"), F.col("gain_share").alias("value"))
    return rows.unionByName(gain).unionByName(best).unionByName(imp)
