"""Queries on inputs at the edges: raw values, nulls, text keys, one class, constant columns, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.functions.expressions import label_code
from churnlens.operators import bins as B
from churnlens.operators import logit as L
from churnlens.operators import metrics as M
from churnlens.operators import prepare as X
from churnlens.operators import profile as P
from churnlens.operators.clean import below, below_sql, encode_gender
from churnlens.operators.explain import background_sample, shapley, shapley_sampled
from churnlens.operators.rank import global_rank
from churnlens.plans.clean_queries import clean, raw
from churnlens.plans.model_prep_queries import scored
from churnlens.plans.oracle_sql import BASE, CLEAN, RAW, md5_hex, with_
from churnlens.plans.registry import register
from churnlens.session import scratch_path
from churnlens.sources.fixtures import churn_base
from churnlens.sources.io import describe_schema, scan_csv, write_csv
from churnlens.sources.tables import read_table

# ---- A2 on the raw table, where salaries of 1e21 stand ----------------------

_RAW_MEAN = {
    "Salary": "CAST(CAST(SUM(CAST(CAST(ROUND(Salary * 100) AS VARCHAR) AS DECIMAL(38, 0))) AS VARCHAR) AS DOUBLE) / CAST(COUNT(Salary) * 100 AS DOUBLE)",
    "Balance": "CAST(SUM(CAST(ROUND(Balance * 100) AS BIGINT)) AS DOUBLE) / (COUNT(Balance) * 100)",
    "Age": "CAST(SUM(Age) AS DOUBLE) / COUNT(Age)",
}


@register("describe_raw", with_(RAW, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, CAST(MIN({c}) AS DOUBLE) AS min, ROUND(quantile_cont({c}, 0.25), 6) AS q1, "
    f"ROUND(quantile_cont({c}, 0.5), 6) AS median, printf('%.9e', {m}) AS mean, ROUND(quantile_cont({c}, 0.75), 6) AS q3, "
    f"CAST(MAX({c}) AS DOUBLE) AS max, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM craw"
    for c, m in _RAW_MEAN.items())))
def q_describe_raw(spark, sf):
    s = P.summary6(raw(spark, sf), list(_RAW_MEAN), {"Salary": 2, "Balance": 2})
    return s.withColumn("mean", F.format_string("%.9e", "mean"))    # the engines differ in the last bit at 1e18


# ---- X2 on derived columns ---------------------------------------------------

_INTS = {"Age_Tenure", "Age_squared", "Tenure_squared"}
_ENG = {"Age_Tenure": "Age * Tenure", "Salary_per_Age": "Salary / Age", "Balance_per_Age": "Balance / Age",
        "Salary_per_Tenure": "Salary / (Tenure + 1)", "Balance_Salary_Ratio": "Balance / Salary",
        "Salary_per_Product": "Salary / (Products_in_Use + 1)", "Age_squared": "Age * Age", "Tenure_squared": "Tenure * Tenure"}


def _eng_mean(c):
    return f"CAST(SUM({c}) AS DOUBLE) / COUNT({c})" if c in _INTS else f"ROUND(AVG({c}), 6)"


@register("scale_engineered", with_(CLEAN + f""",
eng AS (SELECT Customer_ID, {', '.join(f'{e} AS {c}' for c, e in _ENG.items())} FROM clean),
st AS (SELECT {', '.join(f'{_eng_mean(c)} AS m_{c}, COALESCE(NULLIF(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS s_{c}' for c in _ENG)} FROM eng)""",
    f"SELECT Customer_ID, {', '.join(f'ROUND(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in _ENG)} FROM eng, st"))
def q_scale_engineered(spark, sf):
    d = X.engineer_features(clean(spark, sf)).select("Customer_ID", *_ENG)
    return X.fit_scaler(d, list(_ENG)).transform(d, places=6)


# ---- R1 with nulls and with text keys ---------------------------------------

@register("rank_with_nulls", with_(RAW, """
SELECT Customer_ID, Age, row_number() OVER (ORDER BY Age ASC NULLS FIRST, Customer_ID) AS rank,
       row_number() OVER (ORDER BY Age DESC NULLS LAST, Customer_ID DESC) AS rank_desc
FROM (SELECT DISTINCT Customer_ID, Age FROM craw)"""))
def q_rank_with_nulls(spark, sf):
    d = raw(spark, sf).select("Customer_ID", "Age").distinct()
    up = global_rank(d, ["Age", "Customer_ID"], n_buckets=16)
    return global_rank(up, ["Age", "Customer_ID"], descending=True, n_buckets=16, out="rank_desc")


@register("rank_by_text", "SELECT c_name, row_number() OVER (ORDER BY c_name) AS position FROM customer")
def q_rank_by_text(spark, sf):
    return global_rank(read_table(spark, sf, "customer", ["c_name"]), ["c_name"], n_buckets=16, out="position")


# ---- X1, X3: rows without a label, and unshuffled folds ----------------------

@register("split_null_label", with_(RAW, """
SELECT y, COUNT(*) AS n FROM (SELECT CASE WHEN Age IS NULL THEN NULL ELSE "Left" END AS y FROM (SELECT DISTINCT * FROM craw)) GROUP BY y"""))
def q_split_null_label(spark, sf):
    """Every row is on one side: the counts of both sides add up to the table."""
    d = raw(spark, sf).distinct().withColumn("y", F.when(F.col("Age").isNotNull(), F.col("Left"))).select("Customer_ID", "y")
    s = X.stratified_split(d, "Customer_ID", "y", 0.2)
    return s.groupBy("y").agg((F.sum("is_test") + F.sum(1 - F.col("is_test"))).cast("bigint").alias("n"))


@register("folds_unshuffled", with_(CLEAN, """
SELECT Customer_ID, "Left", CAST(FLOOR((r - 1) * 5 / nc) AS INTEGER) AS fold FROM (
  SELECT Customer_ID, "Left", row_number() OVER (PARTITION BY "Left" ORDER BY Customer_ID) AS r,
         COUNT(*) OVER (PARTITION BY "Left") AS nc FROM clean)"""))
def q_folds_unshuffled(spark, sf):
    return X.stratified_folds(clean(spark, sf), "Customer_ID", "Left", 5, shuffle=False).select("Customer_ID", "Left", "fold")


# ---- E1, E2, E4: collinear points; one class ---------------------------------

_SCORED = """,
sc AS (SELECT CAST(Age + 15 * CASE WHEN Gender = 'Female' THEN 1 ELSE 0 END - 6 * Products_in_Use AS DOUBLE) / 100 AS score,
              Left_planted AS label FROM cb)"""


@register("roc_curve_collinear", with_(BASE + _SCORED + """,
g AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM sc GROUP BY score),
c AS (SELECT *, SUM(pos) OVER w AS tps, SUM(neg) OVER w AS fps, SUM(pos) OVER () AS p, SUM(neg) OVER () AS n,
             lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn
      FROM g WINDOW w AS (ORDER BY score DESC))""", """
SELECT score AS threshold, CAST(fps AS DOUBLE) / n AS fpr, CAST(tps AS DOUBLE) / p AS tpr,
       CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps FROM c WHERE np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0, 0, 0"""))
def q_roc_curve_collinear(spark, sf):
    return M.roc_curve(scored(spark, sf), drop_collinear=True)


@register("one_class_metrics", with_(BASE + _SCORED, """
SELECT CAST(NULL AS DOUBLE) AS auc, CAST('inf' AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS j, CAST(0 AS DOUBLE) AS tpr,
       CAST(NULL AS DOUBLE) AS fpr, COUNT(DISTINCT score) + 1 AS n_roc, COUNT(DISTINCT score) + 1 AS n_pr FROM sc"""))
def q_one_class_metrics(spark, sf):
    """Only positives: rates of the empty class are null, nothing throws."""
    d = scored(spark, sf).withColumn("label", F.lit(1))
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    pr = M.pr_curve(d).where("recall is not null")
    one = M.auc(d).select("auc", F.lit(1).alias("i"))
    y = M.youden(d).select("threshold", "j", "tpr", "fpr", F.lit(1).alias("i"))
    r, p = n(M.roc_curve(d), "n_roc").withColumn("i", F.lit(1)), n(pr, "n_pr").withColumn("i", F.lit(1))
    return one.join(y, "i").join(r, "i").join(p, "i").drop("i")     # one row each


# ---- B2, B4, B5 on a constant column -----------------------------------------

@register("constant_bins", with_(BASE, """
SELECT 'cut_n' AS rule, 9 AS k, CAST(6.9993 AS DOUBLE) AS lo, CAST(7 AS DOUBLE) AS hi, COUNT(*) AS n FROM cb
UNION ALL SELECT 'hist_bins', 0, CAST(7 AS DOUBLE), CAST(7 AS DOUBLE), COUNT(*) FROM cb
UNION ALL SELECT 'hist_sturges', 0, CAST(5 AS DOUBLE), CAST(10 AS DOUBLE), COUNT(*) FROM cb"""))
def q_constant_bins(spark, sf):
    d = churn_base(spark, sf).select(F.lit(7.0).alias("x"))
    a = B.cut_n(d, "x", 20).groupBy("bin_idx", "bin_lo", "bin_hi").agg(F.count(F.lit(1)).alias("n"))
    b, c = B.hist_bins(d, "x", 30), B.hist_sturges(d, "x")
    return (a.select(F.lit("cut_n").alias("rule"), F.col("bin_idx").alias("k"), F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"), "n")
            .unionByName(b.select(F.lit("hist_bins").alias("rule"), "k", F.col("center").alias("lo"), F.col("center").alias("hi"), "n"))
            .unionByName(c.select(F.lit("hist_sturges").alias("rule"), "k", "lo", "hi", "n")))


# ---- P5, P15, A17, S1, S2, S4 ------------------------------------------------

@register("label_code", with_(RAW, """
SELECT CASE WHEN "Left" = 0 THEN 'Retained' WHEN "Left" = 1 THEN 'Churned' END AS status, COUNT(*) AS n FROM craw GROUP BY 1"""))
def q_label_code(spark, sf):
    return raw(spark, sf).select(label_code("Left", {0: "Retained", 1: "Churned"}).alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))


#: The reference's literal is 500; the derived salaries of this fixture are larger.
LOW_SALARY = 220_000


@register("low_salary_hist", with_(RAW, f"""
SELECT CAST(k * 5000 AS DOUBLE) AS center, CAST(k * 5000 - 2500 AS DOUBLE) AS lo, CAST(k * 5000 + 2500 AS DOUBLE) AS hi, COUNT(*) AS n
FROM (SELECT CAST(CEIL((Salary - 2500.0) / 5000.0) AS BIGINT) AS k FROM craw WHERE {below_sql('Salary', LOW_SALARY)}) GROUP BY k"""))
def q_low_salary_hist(spark, sf):
    return B.hist_width(below(raw(spark, sf), "Salary", LOW_SALARY), "Salary", 5000.0)


@register("fold_summary", with_(CLEAN, """
SELECT 'age' AS model, 'mean' AS metric, ROUND(AVG(v), 9) AS mean, ROUND(stddev_pop(v), 9) AS std, COUNT(*) AS n_folds
FROM (SELECT Source, CAST(SUM(Age) AS DOUBLE) / COUNT(*) AS v FROM clean GROUP BY Source)"""))
def q_fold_summary(spark, sf):
    v = clean(spark, sf).groupBy("Source").agg((F.sum("Age") / F.count(F.lit(1))).alias("value"))
    d = v.select(F.lit("age").alias("model"), F.lit("mean").alias("metric"), "value")
    return P.fold_summary(d).select("model", "metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n_folds")


_CSV = ["Customer_ID", "Gender", "Age", "Tenure", "Score", "Salary", "Balance", "Products_in_Use", "Left"]


@register("csv_round_trip", with_(RAW, """
SELECT Customer_ID, Gender, CAST(Age AS DOUBLE) AS Age, Tenure, CAST(Score AS DOUBLE) AS Score, Salary, Balance, Products_in_Use, "Left" FROM craw"""))
def q_csv_round_trip(spark, sf):
    """The raw table written as CSV and read back, missing ages included."""
    import uuid
    return scan_csv(spark, write_csv(raw(spark, sf).select(*_CSV), scratch_path(spark, f"csv-{uuid.uuid4().hex}")))


@register("describe_schema", """
SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) t("column", type)""")
def q_describe_schema(spark, sf):
    d = read_table(spark, sf, "customer")
    return describe_schema(d).where(F.length("sample") > 0).select("column", "type")


# ---- L1, L2, L4, T4 on one binary feature, where the fit has a closed form ----

_CELLS = """,
c4 AS (SELECT CAST(SUM(CASE WHEN Gender = 'Male' AND Left_planted = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS a,
              CAST(SUM(CASE WHEN Gender = 'Male' AND Left_planted = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS b,
              CAST(SUM(CASE WHEN Gender <> 'Male' AND Left_planted = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS c,
              CAST(SUM(CASE WHEN Gender <> 'Male' AND Left_planted = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d FROM cb),
fit AS (SELECT 'Gender' AS feature, ln(a * d / (b * c)) AS beta, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM c4
        UNION ALL SELECT 'const', ln(c / d), sqrt(1 / c + 1 / d) FROM c4)"""


def _gendered(spark, sf):
    return encode_gender(churn_base(spark, sf))


@register("logit_binary", with_(BASE + _CELLS, f"""
SELECT feature, ROUND(beta, 6) AS coefficient, ROUND(se, 6) AS std_error, ROUND(beta / se, 5) AS z, ROUND(exp(beta), 6) AS odds_ratio,
       ROUND(exp(beta - {L.Z95} * se), 5) AS ci_lower, ROUND(exp(beta + {L.Z95} * se), 5) AS ci_upper FROM fit"""))
def q_logit_binary(spark, sf):
    t = L.logit_inference(_gendered(spark, sf), ["Gender"], "Left_planted", scale=False)
    return t.select("feature", F.round("coefficient", 6).alias("coefficient"), F.round("std_error", 6).alias("std_error"), F.round("z", 5).alias("z"),
                    F.round("odds_ratio", 6).alias("odds_ratio"), F.round("ci_lower", 5).alias("ci_lower"), F.round("ci_upper", 5).alias("ci_upper"))


@register("logit_summary_binary", with_(BASE + _CELLS + """,
ll AS (SELECT a + b + c + d AS n, a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)) AS l1,
              (a + c) * ln((a + c) / (a + b + c + d)) + (b + d) * ln((b + d) / (a + b + c + d)) AS l0 FROM c4)""", """
SELECT CAST(n AS BIGINT) AS n, 1 AS df_model, CAST(n - 2 AS BIGINT) AS df_resid, ROUND(l1, 5) AS loglik, ROUND(l0, 5) AS loglik_null,
       ROUND(1 - l1 / l0, 6) AS pseudo_r2, ROUND(2 * (l1 - l0), 5) AS llr, ROUND(4 - 2 * l1, 5) AS aic FROM ll"""))
def q_logit_summary_binary(spark, sf):
    t = L.logit_summary(_gendered(spark, sf), ["Gender"], "Left_planted", scale=False)
    return t.select("n", "df_model", "df_resid", *[F.round(c, 5).alias(c) for c in ("loglik", "loglik_null")], F.round("pseudo_r2", 6).alias("pseudo_r2"),
                    F.round("llr", 5).alias("llr"), F.round("aic", 5).alias("aic"))


@register("odds_ratio_binary", with_(BASE + _CELLS, """
SELECT feature, ROUND(abs(exp(beta) - 1), 6) AS distance_from_1 FROM fit WHERE feature <> 'const'"""))
def q_odds_ratio_binary(spark, sf):
    t = L.odds_ratio_order(L.logit_inference(_gendered(spark, sf), ["Gender"], "Left_planted", scale=False), 10, "asc")
    return t.select("feature", F.round("distance_from_1", 6).alias("distance_from_1"))


@register("effect_text_binary", with_(BASE + _CELLS, """
SELECT feature, ROUND(abs(exp(beta) - 1), 6) AS effect_magnitude,
       printf('%s: one step up %s the odds of leaving by %.1f %%', feature, CASE WHEN beta > 0 THEN 'raises' ELSE 'lowers' END,
              CASE WHEN beta > 0 THEN (exp(beta) - 1) * 100 ELSE (1 - exp(beta)) * 100 END) AS text
FROM fit WHERE feature <> 'const' AND abs(beta / se) > 1.959964"""))
def q_effect_text_binary(spark, sf):
    t = L.effect_text(L.logit_inference(_gendered(spark, sf), ["Gender"], "Left_planted", scale=False))
    return t.select("feature", F.round("effect_magnitude", 6).alias("effect_magnitude"), "text")


@register("logit_fit_binary", with_(BASE + _CELLS, "SELECT feature, ROUND(beta, 4) AS coefficient FROM fit"))
def q_logit_fit_binary(spark, sf):
    m = L.logit_fit(_gendered(spark, sf), ["Gender"], "Left_planted", scale=False)
    rows = [("Gender", float(m.coefficients[0])), ("const", float(m.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double").withColumn("coefficient", F.round("coefficient", 4))


# ---- V7 on a linear margin, where each attribution has a closed form ----------

_LINEAR = {"Age": 0.5, "Tenure": -1.25, "Products_in_Use": 3.0}


_LINEAR_SQL = with_(CLEAN + f""",
bg AS (SELECT {', '.join(f'AVG({c}) AS m_{c}' for c in _LINEAR)} FROM (SELECT * FROM clean ORDER BY {md5_hex(17, 'Customer_ID')} LIMIT 100)),
w AS (SELECT Customer_ID, {', '.join(f'{b} * ({c} - m_{c}) AS p_{c}' for c, b in _LINEAR.items())},
             {' + '.join(f'{b} * m_{c}' for c, b in _LINEAR.items())} AS base_value,
             {' + '.join(f'{b} * {c}' for c, b in _LINEAR.items())} AS margin FROM clean, bg)""",
    "\nUNION ALL\n".join(f"SELECT Customer_ID, '{c}' AS feature, ROUND(p_{c}, 6) AS phi, ROUND(base_value, 6) AS base_value, ROUND(CAST(margin AS DOUBLE), 6) AS margin FROM w" for c in _LINEAR))


@register("shapley_linear", _LINEAR_SQL)
def q_shapley_linear(spark, sf):
    d = clean(spark, sf)
    linear = sum((F.col(c) * b for c, b in _LINEAR.items()), F.lit(0.0))
    out = shapley(lambda x: x.withColumn("margin", linear), d, background_sample(d), list(_LINEAR))
    return out.select("Customer_ID", "feature", *[(F.round(c, 6) + 0.0).alias(c) for c in ("phi", "base_value", "margin")])


@register("shapley_sampled_linear", _LINEAR_SQL)
def q_shapley_sampled_linear(spark, sf):
    """The sampled attributions of an additive model are its exact ones: every background row serves as many pairs."""
    d = clean(spark, sf)
    linear = sum((F.col(c) * b for c, b in _LINEAR.items()), F.lit(0.0))
    out = shapley_sampled(lambda x: x.withColumn("margin", linear), d, background_sample(d), list(_LINEAR))
    return out.select("Customer_ID", "feature", *[(F.round(c, 6) + 0.0).alias(c) for c in ("phi", "base_value", "margin")])

