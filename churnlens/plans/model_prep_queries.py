"""Queries for phases 4-5: split, folds, scaler, features, curves and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import metrics as M
from churnlens.operators import prepare as X
from churnlens.plans.clean_queries import clean
from churnlens.plans.oracle_sql import BASE, CLEAN, FEATURES, md5_hex, with_
from churnlens.plans.registry import register
from churnlens.session import inputs_key, stored
from churnlens.sources.fixtures import churn_base

MONEY = {"Salary": 2, "Balance": 2}
SEED = 17

# ---- X1-X4 -----------------------------------------------------------------

_QUOTA_CTE = f""",
cls AS (SELECT "Left" AS y, COUNT(*) AS nc FROM clean GROUP BY 1),
tot AS (SELECT SUM(nc) AS n, CAST(CEIL(CAST(0.2 AS DOUBLE) * SUM(nc)) AS BIGINT) AS n_test FROM cls),
qb AS (SELECT y, nc, n, (nc * (n - n_test)) // n AS fl, (nc * (n - n_test)) % n AS rem, n - n_test AS n_train
       FROM cls, tot),
qa AS (SELECT y, nc, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= n_train - SUM(fl) OVER ()
                               THEN 1 ELSE 0 END AS n_train_c FROM qb),
quota AS (SELECT y, CAST(nc AS BIGINT) AS n, CAST(n_train_c AS BIGINT) AS n_train,
                 CAST(nc - n_train_c AS BIGINT) AS n_test FROM qa),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY "Left" ORDER BY {md5_hex(SEED, 'Customer_ID')}) AS r
           FROM clean c),
split AS (SELECT ranked.* EXCLUDE (r), CAST(r <= q.n_test AS INTEGER) AS is_test
          FROM ranked JOIN quota q ON ranked."Left" = q.y)"""


def split_df(spark, sf, seed=SEED):
    return X.stratified_split(clean(spark, sf), "Customer_ID", "Left", 0.2, seed)


@register("split_quota", with_(CLEAN + _QUOTA_CTE, 'SELECT y AS "Left", n, n_train, n_test FROM quota'))
def q_split_quota(spark, sf):
    s = split_df(spark, sf)
    return s.groupBy("Left").agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(1 - F.col("is_test")).cast("bigint").alias("n_train"),
                                 F.sum("is_test").cast("bigint").alias("n_test"))


@register("split_rows", with_(CLEAN + _QUOTA_CTE, 'SELECT Customer_ID, "Left", is_test FROM split'))
def q_split_rows(spark, sf):
    return split_df(spark, sf).select("Customer_ID", "Left", "is_test")


@register("folds", with_(CLEAN + _QUOTA_CTE + f""",
tr AS (SELECT * FROM split WHERE is_test = 0)""", f"""
SELECT Customer_ID, "Left",
       CAST((row_number() OVER (PARTITION BY "Left" ORDER BY {md5_hex(42, 'Customer_ID')}) - 1) % 5 AS INTEGER) AS fold
FROM tr"""))
def q_folds(spark, sf):
    tr = split_df(spark, sf).where("is_test = 0")
    return X.stratified_folds(tr, "Customer_ID", "Left", 5, seed=42).select("Customer_ID", "Left", "fold")


def _scale_sql():
    def mean(c):
        if c in MONEY:
            return f"CAST(SUM(CAST(ROUND({c} * 100) AS BIGINT)) AS BIGINT) / (COUNT({c}) * 100)"
        return f"CAST(SUM(CAST({c} AS BIGINT)) AS BIGINT) / COUNT({c})"
    stats = ", ".join(f"{mean(c)} AS m_{c}, COALESCE(NULLIF(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS s_{c}"
                      for c in FEATURES)
    cols = ", ".join(f"ROUND(({c} - m_{c}) / s_{c}, 9) AS {c}" for c in FEATURES)
    return with_(CLEAN + _QUOTA_CTE + f""",
st AS (SELECT {stats} FROM split WHERE is_test = 0)""", f'SELECT Customer_ID, "Left", is_test, {cols} FROM split, st')


def scaled_split(spark, sf, seed=SEED):
    """Split + scaler fitted on the training rows; written once per session."""
    def make():
        s = split_df(spark, sf, seed)
        return X.fit_scaler(s.where("is_test = 0"), FEATURES, MONEY).transform(s)

    return stored(spark, "scaled-split", (inputs_key(spark, sf), seed), make)


@register("scale", _scale_sql())
def q_scale(spark, sf):
    return scaled_split(spark, sf).select("Customer_ID", "Left", "is_test", *FEATURES)


@register("engineer_features", with_(CLEAN, """
SELECT Customer_ID, Age * Tenure AS Age_Tenure, Salary / Age AS Salary_per_Age, Balance / Age AS Balance_per_Age,
       Salary / (Tenure + 1) AS Salary_per_Tenure, Balance / Salary AS Balance_Salary_Ratio,
       Salary / (Products_in_Use + 1) AS Salary_per_Product, ROUND(ln(1 + Salary), 9) AS Log_Salary,
       ROUND(ln(1 + Balance), 9) AS Log_Balance, Salary * Salary AS Salary_squared, Age * Age AS Age_squared,
       Tenure * Tenure AS Tenure_squared
FROM clean"""))
def q_engineer_features(spark, sf):
    return X.engineer_features(clean(spark, sf)).select("Customer_ID", *X.ENGINEERED)


# ---- E1-E12 on a planted score --------------------------------------------

SCORES = {
    "basic": ("CAST(Age AS DOUBLE) / 100", lambda: F.col("Age").cast("double") / 100),
    "tuned": ("CAST(Age + 15 * CASE WHEN Gender = 'Female' THEN 1 ELSE 0 END - 6 * Products_in_Use AS DOUBLE) / 100",
              lambda: (F.col("Age") + 15 * F.when(F.col("Gender") == "Female", 1).otherwise(0)
                       - 6 * F.col("Products_in_Use")).cast("double") / 100),
}


def scored(spark, sf, which="tuned"):
    return churn_base(spark, sf).select("Customer_ID", SCORES[which][1]().alias("score"),
                                        F.col("Left_planted").alias("label"))


def _roc_ctes(which="tuned", suffix=""):
    return f""",
sc{suffix} AS (SELECT Customer_ID, {SCORES[which][0]} AS score, Left_planted AS label FROM cb),
rc{suffix} AS (SELECT score AS threshold, CAST(SUM(label) AS BIGINT) AS pos, CAST(SUM(1 - label) AS BIGINT) AS neg
       FROM sc{suffix} GROUP BY score),
rt{suffix} AS (SELECT threshold, pos, neg,
              CAST(SUM(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tps,
              CAST(SUM(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fps,
              CAST(SUM(pos) OVER () AS BIGINT) AS P, CAST(SUM(neg) OVER () AS BIGINT) AS N FROM rc{suffix}),
pts{suffix} AS (SELECT threshold, tps, fps, P, N FROM rt{suffix}
       UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0, MAX(P), MAX(N) FROM rt{suffix}),
yd{suffix} AS (SELECT threshold, tps / P - fps / N AS j, tps / P AS tpr, fps / N AS fpr FROM pts{suffix}
       ORDER BY tps * N - fps * P DESC, threshold DESC LIMIT 1)"""


def _cm(suffix=""):
    return f"""(SELECT CAST(SUM(CASE WHEN label = 1 AND score >= t THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(SUM(CASE WHEN label = 0 AND score >= t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(SUM(CASE WHEN label = 1 AND NOT score >= t THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(SUM(CASE WHEN label = 0 AND NOT score >= t THEN 1 ELSE 0 END) AS BIGINT) AS tn
 FROM sc{suffix}, (SELECT threshold AS t FROM yd{suffix}))"""


def _metric_cols():
    return """tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
       ((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END)
        + (CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END)) / 2 AS balanced_accuracy"""


@register("roc_curve", with_(BASE + _roc_ctes(), "SELECT threshold, fps / N AS fpr, tps / P AS tpr, tps, fps FROM pts"))
def q_roc_curve(spark, sf):
    return M.roc_curve(scored(spark, sf), "score", "label")


@register("youden", with_(BASE + _roc_ctes(), "SELECT threshold, j, tpr, fpr FROM yd"))
def q_youden(spark, sf):
    return M.youden(scored(spark, sf), "score", "label")


@register("pr_curve", with_(BASE + _roc_ctes(), """
SELECT threshold, tps / (tps + fps) AS precision, tps / P AS recall FROM rt WHERE tps - pos < P
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0"""))
def q_pr_curve(spark, sf):
    return M.pr_curve(scored(spark, sf), "score", "label")


@register("auc", with_(BASE + _roc_ctes(), """
SELECT CAST(SUM(pos * (2 * (N - fps) + neg)) AS BIGINT) / (MAX(P) * MAX(N) * 2) AS auc FROM rt"""))
def q_auc(spark, sf):
    return M.auc(scored(spark, sf), "score", "label")


@register("threshold_metrics", with_(BASE + _roc_ctes(), f"""
SELECT 'youden' AS rule, (SELECT threshold FROM yd) AS threshold, {_metric_cols()} FROM {_cm()}
UNION ALL
SELECT 'default', 0.5, {_metric_cols()} FROM (
  SELECT CAST(SUM(CASE WHEN label = 1 AND score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(SUM(CASE WHEN label = 0 AND score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(SUM(CASE WHEN label = 1 AND NOT score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(SUM(CASE WHEN label = 0 AND NOT score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM sc)"""))
def q_threshold_metrics(spark, sf):
    return M.threshold_metrics(scored(spark, sf), "score", "label")


def _youden_pred(df):
    t = M.youden(df, "score", "label").select("threshold").scalar()
    return M.apply_threshold(F.col("score"), t)


@register("confusion", with_(BASE + _roc_ctes(), f"""
SELECT actual, predicted, n FROM {_cm()}, LATERAL (VALUES (1, 1, tp), (0, 1, fp), (1, 0, fn), (0, 0, tn))
  v(actual, predicted, n)"""))
def q_confusion(spark, sf):
    d = scored(spark, sf)
    return M.confusion_matrix(d, "label", _youden_pred(d))


@register("classification_report", with_(BASE + _roc_ctes() + f""",
cm AS {_cm()},
pr AS (SELECT CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0,
              CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
              CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0.0 END AS f0, tn + fp AS s0,
              CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
              CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, tp + fn AS s1,
              (tp + tn) / (tp + fp + fn + tn) AS acc, tp + fp + fn + tn AS n FROM cm)""", """
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM pr
UNION ALL SELECT '1', p1, r1, f1, s1 FROM pr
UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM pr
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM pr
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n
FROM pr"""))
def q_classification_report(spark, sf):
    d = scored(spark, sf)
    return M.classification_report(d, "label", _youden_pred(d))
