"""Queries for model search and resampled evaluation.

What rests on neighbours is checked in SQL from the folds to the last metric;
grids of trees and networks are checked by local tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import mlp as N
from churnlens.operators import prepare as X
from churnlens.operators import report as R
from churnlens.operators import trees as T
from churnlens.operators import tuning as V
from churnlens.operators.folds import class_weight, keyed_oversample, prepared
from churnlens.operators.neighbors import knn_approx, knn_topk
from churnlens.plans.model_prep_queries import SCORES, scored
from churnlens.plans.model_queries import KNN_BEST, MLP_BEST, mlp, train_test
from churnlens.plans.neighbor_queries import _SMOTE_SEED, _euclid, _manhattan, _scaled_ctes
from churnlens.plans.oracle_sql import BASE, FEATURES, md5_hex, md5_uniform, with_
from churnlens.plans.registry import register
from churnlens.session import inputs_key, stored, written

KMAX = 33
NET = {k: v for k, v in MLP_BEST.items() if k in ("hidden", "activation", "alpha", "learning_rate", "batch_size")}


def train_folds(spark, sf, shuffle=True, scaled=True):
    def make():
        tr, _ = train_test(spark, sf, scaled=scaled)
        return X.stratified_folds(tr, "Customer_ID", "Left", 5, seed=42, shuffle=shuffle)

    return stored(spark, f"train-folds-{shuffle}-{scaled}", inputs_key(spark, sf), make)


# ---- SQL parts -----------------------------------------------------------------

def _folds_sql(src, shuffle):
    if shuffle:
        return f"""SELECT *, CAST((row_number() OVER (PARTITION BY "Left" ORDER BY {md5_hex(42, 'Customer_ID')}) - 1) % 5 AS INTEGER) AS fold FROM {src}"""
    return f"""SELECT * EXCLUDE (r0, nc), CAST(floor((r0 - 1) * 5 / nc) AS INTEGER) AS fold FROM (
       SELECT *, row_number() OVER (PARTITION BY "Left" ORDER BY Customer_ID) AS r0, COUNT(*) OVER (PARTITION BY "Left") AS nc FROM {src})"""


def _proba_sql(weights):
    dist = "CASE WHEN SUM(CASE WHEN d = 0 THEN 1 ELSE 0 END) > 0 THEN SUM(CASE WHEN d = 0 THEN y ELSE 0 END) / SUM(CASE WHEN d = 0 THEN 1 ELSE 0 END) ELSE SUM(CASE WHEN d > 0 THEN y / d END) / SUM(CASE WHEN d > 0 THEN 1 / d END) END"
    if weights == "uniform":
        return "ROUND(SUM(y) / COUNT(*), 9)"
    return f"ROUND({dist}, 9)" if weights == "distance" else f"ROUND(CASE WHEN {weights} = 'uniform' THEN SUM(y) / COUNT(*) ELSE {dist} END, 9)"


def _grid_ctes(src, sfx=""):
    """From a table with folds: pairs, neighbours, every point's scores, and the ranked grid ``gr``."""
    return f""",
kp{sfx} AS (SELECT 'euclidean' AS metric, q.fold, q.Customer_ID AS qid, q."Left" AS y0, b.Customer_ID AS nid, b."Left" AS y,
              ROUND({_euclid('q', 'b')}, 9) AS d FROM {src} q, {src} b WHERE q.fold <> b.fold
       UNION ALL SELECT 'manhattan', q.fold, q.Customer_ID, q."Left", b.Customer_ID, b."Left", ROUND({_manhattan('q', 'b')}, 9)
       FROM {src} q, {src} b WHERE q.fold <> b.fold),
kr{sfx} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, qid ORDER BY d, nid) AS r FROM kp{sfx}) WHERE r <= {KMAX}),
cs{sfx} AS (SELECT metric, fold, qid, y0, r, SUM(y) OVER w / r AS u, SUM(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER w AS z,
              SUM(CASE WHEN d = 0 THEN y ELSE 0 END) OVER w AS zy, SUM(CASE WHEN d > 0 THEN y / d END) OVER w AS sy,
              SUM(CASE WHEN d > 0 THEN 1 / d END) OVER w AS s1 FROM kr{sfx} WINDOW w AS (PARTITION BY metric, qid ORDER BY r)),
pr{sfx} AS (SELECT metric, fold, r AS k, 'uniform' AS weights, y0, ROUND(u, 9) AS p FROM cs{sfx} WHERE r >= 3 AND r % 2 = 1
       UNION ALL SELECT metric, fold, r, 'distance', y0, ROUND(CASE WHEN z > 0 THEN zy / z ELSE sy / s1 END, 9) FROM cs{sfx}
       WHERE r >= 3 AND r % 2 = 1),
g{sfx} AS (SELECT metric, fold, k, weights, p, SUM(y0) AS pos, SUM(1 - y0) AS neg FROM pr{sfx} GROUP BY ALL),
gc{sfx} AS (SELECT *, SUM(neg) OVER (PARTITION BY metric, fold, k, weights ORDER BY p) - neg AS below FROM g{sfx}),
au{sfx} AS (SELECT metric, fold, k, weights, CAST(SUM(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * SUM(pos) * SUM(neg)) AS auc
       FROM gc{sfx} GROUP BY metric, fold, k, weights),
ms{sfx} AS (SELECT metric, CAST(k AS INTEGER) AS k, weights, ROUND(AVG(auc), 9) AS mean_auc, ROUND(stddev_pop(auc), 9) AS std_auc
       FROM au{sfx} GROUP BY metric, k, weights),
gr{sfx} AS (SELECT *, row_number() OVER (ORDER BY mean_auc DESC, metric, k, weights) AS rank FROM ms{sfx})"""


def _curve_ctes(scores, by, sfx=""):
    """From (by..., y, p): one row of metrics for each group (``cm``): AUC, and the counts at the Youden threshold."""
    g = ", ".join(by)
    return f""",
cu{sfx} AS (SELECT {g}, p, CAST(SUM(y) AS BIGINT) AS pos, CAST(SUM(1 - y) AS BIGINT) AS neg FROM {scores} GROUP BY {g}, p),
cc{sfx} AS (SELECT *, CAST(SUM(pos) OVER w AS BIGINT) AS tps, CAST(SUM(neg) OVER w AS BIGINT) AS fps,
              CAST(SUM(pos) OVER (PARTITION BY {g}) AS BIGINT) AS P_, CAST(SUM(neg) OVER (PARTITION BY {g}) AS BIGINT) AS N_
       FROM cu{sfx} WINDOW w AS (PARTITION BY {g} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ca{sfx} AS (SELECT {g}, CAST(SUM(pos * (2 * (N_ - fps) + neg)) AS DOUBLE) / (CAST(MAX(P_) * MAX(N_) AS DOUBLE) * 2) AS auc FROM cc{sfx} GROUP BY {g}),
cb_{sfx} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY tps * N_ - fps * P_ DESC, p DESC) AS best FROM (
       SELECT {g}, p, tps, fps, P_, N_ FROM cc{sfx}
       UNION ALL SELECT {g}, CAST('inf' AS DOUBLE), 0, 0, MAX(P_), MAX(N_) FROM cc{sfx} GROUP BY {g})) WHERE best = 1),
cm{sfx} AS (SELECT a.*, b.p AS threshold, b.tps AS tp, b.fps AS fp, b.P_ - b.tps AS fn, b.N_ - b.fps AS tn
       FROM ca{sfx} a JOIN cb_{sfx} b USING ({g}))"""


_FOLDED = _scaled_ctes() + """,
tb AS (SELECT * FROM scaled WHERE is_test = 0)"""
_CV_LONG = """lg AS (SELECT model, fold, 'AUC' AS metric, auc AS value FROM cm
       UNION ALL SELECT model, fold, 'Accuracy', (tp + tn) / (tp + fp + fn + tn) FROM cm
       UNION ALL SELECT model, fold, 'Recall', CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END FROM cm
       UNION ALL SELECT model, fold, 'Threshold', threshold FROM cm)"""


def _best_cv_ctes(shuffle):
    """Scores of the tuned kNN on every fold (``sc``)."""
    return _FOLDED + f""",
fo AS ({_folds_sql('tb', shuffle)}),
kp AS (SELECT q.fold, q.Customer_ID AS qid, q."Left" AS y0, b.Customer_ID AS nid, b."Left" AS y, ROUND({_manhattan('q', 'b')}, 9) AS d
       FROM fo q, fo b WHERE q.fold <> b.fold),
kr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, nid) AS r FROM kp) WHERE r <= {KMAX}),
sc AS (SELECT 'KNN' AS model, fold, qid, y0 AS y, p FROM (SELECT fold, qid, y0, {_proba_sql('distance')} AS p FROM kr GROUP BY fold, qid, y0))"""


# ---- V1: kNN -------------------------------------------------------------------

@register("grid_search_knn", with_(_FOLDED + f",\nfo AS ({_folds_sql('tb', True)})" + _grid_ctes("fo"), "SELECT * FROM gr"))
def q_grid_search_knn(spark, sf):
    return V.knn_grid(train_folds(spark, sf), FEATURES, "Left")


# ---- K1: the approximate option ------------------------------------------------

@register("knn_approx_recall", with_(_FOLDED + ",\ntq AS (SELECT * FROM scaled WHERE is_test = 1)", """
SELECT CAST(COUNT(*) * LEAST(5, (SELECT COUNT(*) FROM tb)) AS BIGINT) AS n_exact, CAST(1 AS INTEGER) AS recall_at_least_09 FROM tq"""))
def q_knn_approx_recall(spark, sf):
    """Rotated partitions against the exact neighbours of every test row: at least 0.9 of them are found."""
    tr, te = train_test(spark, sf, scaled=True)
    exact = knn_topk(te, tr, FEATURES, k=5).select("qid", "nid")
    near = knn_approx(te, tr, FEATURES, k=5).select("qid", "nid", F.lit(1).alias("found"))
    j = exact.join(near, ["qid", "nid"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.sum("found").alias("n"))
    return j.select("n_exact", (F.col("n") >= 0.9 * F.col("n_exact")).cast("int").alias("recall_at_least_09"))


# ---- V2, V3: cross-validation --------------------------------------------------

@register("cv_with_threshold", with_(_best_cv_ctes(True) + _curve_ctes("sc", ["model", "fold"]) + ",\n" + _CV_LONG, """
SELECT model, metric, ROUND(AVG(value), 9) AS mean, ROUND(stddev_pop(value), 9) AS std FROM lg GROUP BY model, metric"""))
def q_cv_with_threshold(spark, sf):
    s = V.knn_cv_scores(train_folds(spark, sf), FEATURES, label="Left", **KNN_BEST)
    return V.cv_summary(s).select("model", "metric", *[F.round(c, 9).alias(c) for c in ("mean", "std")])


_PLANTED = BASE + """,
pf AS (SELECT *, CAST((row_number() OVER (PARTITION BY Left_planted ORDER BY """ + md5_hex(42, "Customer_ID") + """) - 1) % 5 AS INTEGER) AS fold FROM cb),
sc AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS model, fold, Left_planted AS y, {sql} AS p FROM pf" for m, (sql, _) in SCORES.items()) + ")"


@register("cv_planted", with_(_PLANTED + _curve_ctes("sc", ["model", "fold"]) + ",\n" + _CV_LONG, "SELECT model, fold, metric, value FROM lg"))
def q_cv_planted(spark, sf):
    """V3 on planted scores: two models, five folds, four metrics, one running sum."""
    out = None
    for name in SCORES:
        d = X.stratified_folds(scored(spark, sf, name), "Customer_ID", "label", 5, seed=42)
        s = d.select(F.lit(name).alias("model"), "fold", F.col("label").alias("y"), "score")
        out = s if out is None else out.unionByName(s)
    return V.cv_metrics(out)


def _three_models(spark, sf):
    """Held-out scores of the three tuned models on the same folds, written once (trees on unscaled features, as the reference has them)."""
    def make():
        scaled, plain = train_folds(spark, sf), train_folds(spark, sf, scaled=False)
        knn = V.knn_cv_scores(scaled, FEATURES, label="Left", **KNN_BEST)
        net = N.mlp_cv_scores(scaled, FEATURES, "Left", max_iter=MLP_BEST["max_iter"], validation_fraction=MLP_BEST["validation_fraction"], **NET)

        def trees(tr, va):
            return T.gbt_score(T.gbt_fit(tr, FEATURES, "Left", pos_weight=class_weight(tr, "Left"), **T.BEST), va, FEATURES)

        return knn.unionByName(V.fold_cv_scores(plain, trees, "Left", model="Boosted trees", score="prob", parallelism=5)).unionByName(net)

    return stored(spark, "cv-three-models", inputs_key(spark, sf), make)


@register("cv_three_models")
def q_cv_three_models(spark, sf):
    """V3: kNN, trees and network over five folds, thresholds tuned in each; all metrics from one table of scores."""
    return V.cv_summary(_three_models(spark, sf))


@register("cross_val_auc", with_(_best_cv_ctes(False) + _curve_ctes("sc", ["model", "fold"]), """
SELECT model, ROUND(AVG(auc), 9) AS mean, ROUND(2 * stddev_pop(auc), 9) AS plus_minus FROM cm GROUP BY model"""))
def q_cross_val_auc(spark, sf):
    s = V.knn_cv_scores(train_folds(spark, sf, shuffle=False), FEATURES, label="Left", **KNN_BEST)
    return V.cross_val_auc(s).select("model", *[F.round(c, 9).alias(c) for c in ("mean", "plus_minus")])


@register("cross_val_auc_mlp")
def q_cross_val_auc_mlp(spark, sf):
    """V2 for the tuned network, all five folds trained together."""
    return V.cross_val_auc(N.mlp_cv_scores(train_folds(spark, sf, shuffle=False), FEATURES, "Left", validation_fraction=0.1, **NET))


# ---- V4: learning curves -------------------------------------------------------

_LEARNING = with_(_FOLDED + f""",
fo AS ({_folds_sql('tb', False)}),
fs AS (SELECT fold, COUNT(*) AS n FROM fo GROUP BY fold),
ns AS (SELECT CAST(floor(ROUND(i * ((SELECT SUM(n) FROM fs) - (SELECT MAX(n) FROM fs)) / 10.0, 9)) AS BIGINT) AS train_size FROM range(1, 11) t(i)),
ps AS (SELECT f.fold AS f, fo.Customer_ID AS id, row_number() OVER (PARTITION BY f.fold ORDER BY fo.Customer_ID) AS pos FROM fs f JOIN fo ON fo.fold <> f.fold),
pairs AS (SELECT q.Customer_ID AS qid, q.fold AS qf, q."Left" AS y0, b.Customer_ID AS nid, b."Left" AS y, ROUND({_manhattan('q', 'b')}, 9) AS d FROM fo q, fo b),
asked AS (SELECT f.fold AS f, ns.train_size, fo.Customer_ID AS qid, CASE WHEN fo.fold = f.fold THEN 'validation' ELSE 'train' END AS part
          FROM fs f, ns, fo LEFT JOIN ps ON ps.f = f.fold AND ps.id = fo.Customer_ID WHERE fo.fold = f.fold OR ps.pos <= ns.train_size),
ranked_n AS (SELECT a.f, a.train_size, a.qid, a.part, p.y0, p.y, p.d, row_number() OVER (PARTITION BY a.f, a.train_size, a.qid ORDER BY p.d, p.nid) AS r
             FROM asked a JOIN pairs p ON p.qid = a.qid JOIN ps ON ps.f = a.f AND ps.id = p.nid AND ps.pos <= a.train_size),
sc AS (SELECT f, train_size, qid, part, y0, {_proba_sql('distance')} AS p FROM ranked_n WHERE r <= {KMAX} GROUP BY f, train_size, qid, part, y0),
ac AS (SELECT f, train_size, part, CAST(SUM(CASE WHEN (p > 0.5) = (y0 = 1) THEN 1 ELSE 0 END) AS BIGINT) / COUNT(*) AS value FROM sc GROUP BY f, train_size, part)""", """
SELECT train_size, ROUND(AVG(CASE WHEN part = 'train' THEN value END), 9) AS train_mean, ROUND(stddev_pop(CASE WHEN part = 'train' THEN value END), 9) AS train_std,
       ROUND(AVG(CASE WHEN part = 'validation' THEN value END), 9) AS val_mean, ROUND(stddev_pop(CASE WHEN part = 'validation' THEN value END), 9) AS val_std
FROM ac GROUP BY train_size""")
_CURVE = ("train_mean", "train_std", "val_mean", "val_std")


@register("learning_curve", _LEARNING)
def q_learning_curve(spark, sf):
    """V4 for the tuned kNN: ten sizes, five folds, training and validation accuracy from one pass over the tiles."""
    s = V.knn_learning_scores(train_folds(spark, sf, shuffle=False), FEATURES, label="Left", **KNN_BEST)
    return V.learning_curve(s).select("train_size", *[F.round(c, 9).alias(c) for c in _CURVE])


@register("learning_curve_mlp")
def q_learning_curve_mlp(spark, sf):
    """V4 for the tuned network (AUC): fifty networks, trained together."""
    d = train_folds(spark, sf, shuffle=False)
    sizes = V.fold_sizes(d)
    rows = written(V.fold_positions(d, "Customer_ID", "fold", sorted(sizes)), "learning-rows")
    s = N.mlp_learning_scores(rows, FEATURES, V.train_sizes(sizes), sorted(sizes), "Left", validation_fraction=0.1, **NET)
    return V.learning_curve(s, by="auc")


# ---- V1 with refit: networks and trees -----------------------------------------

def _mlp_grid(spark, sf):
    return stored(spark, "mlp-grid", inputs_key(spark, sf), lambda: N.mlp_grid(train_folds(spark, sf, shuffle=False), FEATURES, "Left", shards=4))


@register("grid_search_mlp")
def q_grid_search_mlp(spark, sf):
    """V1 for networks: all 360 points on five folds, trained together, one job an epoch."""
    return _mlp_grid(spark, sf)


@register("mlp_tuned_against_basic")
def q_mlp_tuned_against_basic(spark, sf):
    """E9 on real models: the network of the library's defaults, and the grid's winner refitted on all training rows."""
    tr, te = train_test(spark, sf, scaled=True)
    basic = N.mlp_fit(tr, FEATURES, "Left", seed=17)
    tuned = N.mlp_fit(tr, FEATURES, "Left", seed=17, max_iter=1000, early_stopping=True, **N.winner(_mlp_grid(spark, sf)))
    return R.compare(R.approach_metrics(basic.transform(te), "basic", "prob", "Left"), R.approach_metrics(tuned.transform(te), "tuned", "prob", "Left"))


def _gbt_grid(spark, sf):
    return stored(spark, "gbt-grid", inputs_key(spark, sf), lambda: T.gbt_grid(train_folds(spark, sf, scaled=False), FEATURES, "Left", grid=T.TUNING_GRID))


@register("grid_search_gbt")
def q_grid_search_gbt(spark, sf):
    """V1 for trees: all 108 points on five folds, every number of trees from one fit, scored by its prefixes."""
    return _gbt_grid(spark, sf)


@register("gbt_tuned_against_basic")
def q_gbt_tuned_against_basic(spark, sf):
    """E9 on real models: trees of the defaults that the search starts from, and its winner refitted on all training rows."""
    tr, te = train_test(spark, sf)
    basic = T.gbt_fit(tr, FEATURES, "Left", max_depth=5, learning_rate=0.1, n_estimators=10, colsample=1.0)
    tuned = T.gbt_fit(tr, FEATURES, "Left", **T.winner(_gbt_grid(spark, sf)))
    return R.compare(R.approach_metrics(T.gbt_score(basic, te, FEATURES), "basic", "prob", "Left"), R.approach_metrics(T.gbt_score(tuned, te, FEATURES), "tuned", "prob", "Left"))


# ---- E13: experiments ------------------------------------------------------------

def _balanced(spark, sf, scaled=True):
    def make():
        tr, _ = train_test(spark, sf, scaled=scaled)
        return keyed_oversample(tr, FEATURES, "Left", "Customer_ID", 5, _SMOTE_SEED)

    return stored(spark, f"balanced-{scaled}", inputs_key(spark, sf), make)


_SMOTE_CTES = f""",
mino AS (SELECT * FROM tb WHERE "Left" = 1),
mr AS (SELECT *, row_number() OVER (ORDER BY Customer_ID) AS r FROM mino),
mp AS (SELECT a.Customer_ID AS qid, b.Customer_ID AS nid, ROUND({_euclid('a', 'b')}, 9) AS distance FROM mino a, mino b WHERE a.Customer_ID <> b.Customer_ID),
mk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, nid) AS rank FROM mp) WHERE rank <= 5),
cnt AS (SELECT SUM(CASE WHEN "Left" = 1 THEN 1 ELSE 0 END) AS n1, SUM(CASE WHEN "Left" = 0 THEN 1 ELSE 0 END) AS n0 FROM tb),
dr AS (SELECT range AS draw FROM cnt, range(CAST(cnt.n0 - cnt.n1 AS BIGINT))),
dd AS (SELECT draw, CAST(FLOOR({md5_uniform(_SMOTE_SEED, "'r' || ':' || CAST(draw AS VARCHAR)")} * n1) + 1 AS BIGINT) AS r,
              CAST(FLOOR({md5_uniform(_SMOTE_SEED, "'n' || ':' || CAST(draw AS VARCHAR)")} * 5) + 1 AS BIGINT) AS j,
              {md5_uniform(_SMOTE_SEED, "'g' || ':' || CAST(draw AS VARCHAR)")} AS gap FROM dr, cnt),
bal AS (SELECT Customer_ID, "Left", {', '.join(FEATURES)} FROM tb
        UNION ALL SELECT -(draw + 1), 1, {', '.join(f"ROUND(s.{c} + gap * (n.{c} - s.{c}), 9)" for c in FEATURES)}
        FROM dd JOIN mr s ON dd.r = s.r JOIN mk k ON k.qid = s.Customer_ID AND k.rank = dd.j JOIN mino n ON n.Customer_ID = k.nid)"""

_EXPERIMENT = with_(_FOLDED + _SMOTE_CTES + f""",
tq AS (SELECT * FROM scaled WHERE is_test = 1),
fo AS ({_folds_sql('tb', False)}),
fb AS ({_folds_sql('bal', False)})""" + _grid_ctes("fo") + _grid_ctes("fb", "_s") + f""",
params AS (SELECT 0 AS pos, 'Basic KNN' AS approach, 'plain' AS src, 'euclidean' AS metric, 5 AS k, 'uniform' AS weights
       UNION ALL SELECT 1, 'KNN with SMOTE', 'smote', 'euclidean', 5, 'uniform'
       UNION ALL SELECT 2, 'KNN with distance weights', 'plain', 'euclidean', 5, 'distance'
       UNION ALL SELECT 3, 'Fine-tuned KNN', 'plain', metric, k, weights FROM gr WHERE rank = 1
       UNION ALL SELECT 4, 'Fine-tuned KNN with SMOTE', 'smote', metric, k, weights FROM gr_s WHERE rank = 1),
tp AS (""" + " UNION ALL ".join(
    f"""SELECT '{src}' AS src, '{m}' AS metric, q.Customer_ID AS qid, q."Left" AS y0, b.Customer_ID AS nid, b."Left" AS y, ROUND({f('q', 'b')}, 9) AS d FROM tq q, {t} b"""
    for src, t in (("plain", "tb"), ("smote", "bal")) for m, f in (("euclidean", _euclid), ("manhattan", _manhattan))) + f"""),
tr_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, metric, qid ORDER BY d, nid) AS r FROM tp) WHERE r <= {KMAX}),
sc AS (SELECT approach, pos_, y0 AS y, p FROM (SELECT a.approach, a.pos AS pos_, t.qid, t.y0, {_proba_sql('a.weights')} AS p
       FROM params a JOIN tr_ t ON t.src = a.src AND t.metric = a.metric AND t.r <= a.k GROUP BY a.approach, a.pos, a.weights, t.qid, t.y0))""" + _curve_ctes("sc", ["approach", "pos_"]), """
SELECT approach, pos_ AS pos, auc, threshold, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
       CAST(row_number() OVER (ORDER BY auc DESC, pos_) = 1 AS INTEGER) AS is_best FROM cm""")


@register("experiment_knn", _EXPERIMENT)
def q_experiment_knn(spark, sf):
    """Basic, SMOTE, distance-weighted, tuned, and tuned on SMOTE rows; both tuned ones by the winner of a full grid.

    The last one balances before it cuts the folds, as the reference does (D10).
    """
    tr, te = train_test(spark, sf, scaled=True)
    bal = _balanced(spark, sf)
    folds = X.stratified_folds(bal, "Customer_ID", "Left", 5, shuffle=False)
    tuned = V.knn_winner(V.knn_grid(train_folds(spark, sf, shuffle=False), FEATURES, "Left"))
    tuned_smote = V.knn_winner(V.knn_grid(written(folds, "balanced-folds"), FEATURES, "Left"))
    out = None
    for pos, (name, base, p) in enumerate([("Basic KNN", tr, dict(k=5)), ("KNN with SMOTE", bal, dict(k=5)), ("KNN with distance weights", tr, dict(k=5, weights="distance")),
                                           ("Fine-tuned KNN", tr, tuned), ("Fine-tuned KNN with SMOTE", bal, tuned_smote)]):
        r = R.approach_metrics(V.knn_fit_score(features=FEATURES, **p)(base, te), name, "proba", "Left", pos)
        out = r if out is None else out.unionByName(r)
    return R.leaderboard(out)


@register("experiment_trees")
def q_experiment_trees(spark, sf):
    """Trees on SMOTE rows with defaults, then tuned with SMOTE, with a class weight, and with both; refitted winners on the test rows.

    Each of the three is tuned over all 162 points. SMOTE rows and weights are made inside each fold (``per_fold``), so none leak into the held-out part.
    """
    tr, te = train_test(spark, sf)
    weight = class_weight(tr.unionByName(te), "Left")       # over all rows, as the reference has it (D7)
    folds = train_folds(spark, sf, scaled=False)
    bal = _balanced(spark, sf, scaled=False)

    def inside(resample):
        def prepare(a, b):
            a, (b,), _ = prepared(a, [b], FEATURES, "Left", "Customer_ID", resample=resample, seed=_SMOTE_SEED)
            return a, b, None
        return T.fold_parts(folds, FEATURES, "Left", prepare=prepare)

    smote = inside("smote")         # the same rows with and without the weight
    out = R.approach_metrics(T.gbt_score(T.gbt_fit(bal, FEATURES, "Left", max_depth=5, learning_rate=0.3, n_estimators=20, colsample=1.0), te, FEATURES), "Basic with SMOTE", "prob", "Left", 0)
    for pos, (name, parts, w, rows) in enumerate([("SMOTE", smote, None, bal), ("Weight", inside("none"), weight, tr), ("Both", smote, weight, bal)], start=1):
        grid = T.gbt_grid(folds, FEATURES, "Left", grid=T.REBALANCING_GRID, parts={f: (a, b, w) for f, (a, b, _) in parts.items()})
        m = T.gbt_fit(rows, FEATURES, "Left", pos_weight=w, **T.winner(grid))
        out = out.unionByName(R.approach_metrics(T.gbt_score(m, te, FEATURES), name, "prob", "Left", pos))
    return R.leaderboard(out)
