"""Queries for section 3.2: statistics, rates, boxes, bins, densities, reshape."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import bins as B
from churnlens.operators import profile as P
from churnlens.operators.density import kde
from churnlens.operators.quantile import quantiles
from churnlens.plans.clean_queries import clean, deduped
from churnlens.plans.oracle_sql import CLEAN, with_
from churnlens.plans.registry import register

NUM6 = ["Salary", "Balance", "Tenure", "Score", "Age", "Products_in_Use"]
MONEY = {"Salary": 2, "Balance": 2}
CORR8 = ["Salary", "Balance", "Tenure", "Score", "Age", "Products_in_Use", "Gender", "Left"]


def _q(c):
    return '"Left"' if c == "Left" else c


def _mean_sql(c):
    if c in MONEY:
        return f"CAST(SUM(CAST(ROUND({c} * 100) AS BIGINT)) AS BIGINT) / (COUNT({c}) * 100)"
    return f"CAST(SUM(CAST({c} AS BIGINT)) AS BIGINT) / COUNT({c})"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ---- A1, A2 ---------------------------------------------------------------

@register("describe_numeric", with_(CLEAN, _union([
    f"SELECT '{c}' AS variable, {_mean_sql(c)} AS mean, ROUND(quantile_cont({c}, 0.5), 6) AS median, "
    f"ROUND(stddev_samp({c}), 6) AS sd FROM clean" for c in NUM6])))
def q_describe_numeric(spark, sf):
    return P.describe_numeric(clean(spark, sf), NUM6, MONEY)


@register("summary6", with_(CLEAN, _union([
    f"SELECT '{c}' AS variable, CAST(MIN({_q(c)}) AS DOUBLE) AS min, ROUND(quantile_cont({_q(c)}, 0.25), 6) AS q1, "
    f"ROUND(quantile_cont({_q(c)}, 0.5), 6) AS median, {_mean_sql(_q(c))} AS mean, "
    f"ROUND(quantile_cont({_q(c)}, 0.75), 6) AS q3, CAST(MAX({_q(c)}) AS DOUBLE) AS max, "
    f"CAST(SUM(CASE WHEN {_q(c)} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM clean"
    for c in NUM6 + ["Gender", "Left"]])))
def q_summary6(spark, sf):
    return P.summary6(clean(spark, sf), NUM6 + ["Gender", "Left"], MONEY)


# ---- A3-A8 -----------------------------------------------------------------

@register("count_by_source", with_(CLEAN, "SELECT Source, COUNT(*) AS n FROM clean GROUP BY Source"))
def q_count_by_source(spark, sf):
    return P.count_by(clean(spark, sf), "Source")


@register("count_by_source_left", with_(CLEAN, """
SELECT Source, "Left", COUNT(*) AS n FROM clean GROUP BY Source, "Left" """))
def q_count_by_source_left(spark, sf):
    return P.count_by(clean(spark, sf), ["Source", "Left"])


def _rate_sql(x):
    return with_(CLEAN, f"""
SELECT {x}, "Left", n, n / SUM(n) OVER (PARTITION BY {x}) AS share
FROM (SELECT {x}, "Left", COUNT(*) AS n FROM clean GROUP BY {x}, "Left")""")


@register("churn_rate_by_source", _rate_sql("Source"))
def q_churn_rate_by_source(spark, sf):
    """Flagship: churn share per branch (the core churn-rate query)."""
    return P.rate_by(clean(spark, sf), "Source", "Left")


@register("churn_rate_by_age", _rate_sql("Age"))
def q_churn_rate_by_age(spark, sf):
    return P.rate_by(clean(spark, sf), "Age", "Left")


@register("churn_rate_by_tenure", _rate_sql("Tenure"))
def q_churn_rate_by_tenure(spark, sf):
    return P.rate_by(clean(spark, sf), "Tenure", "Left")


@register("churn_rate_by_products", _rate_sql("Products_in_Use"))
def q_churn_rate_by_products(spark, sf):
    return P.rate_by(clean(spark, sf), "Products_in_Use", "Left")


@register("churn_rate_by_gender", _rate_sql("Gender"))
def q_churn_rate_by_gender(spark, sf):
    return P.rate_by(clean(spark, sf), "Gender", "Left")


@register("class_distribution", with_(CLEAN, """
SELECT "Left", n, n / SUM(n) OVER () AS share FROM (SELECT "Left", COUNT(*) AS n FROM clean GROUP BY "Left")"""))
def q_class_distribution(spark, sf):
    return P.class_distribution(clean(spark, sf), "Left")


@register("pos_weight", with_(CLEAN, """
SELECT n0, n1, n0 / n1 AS pos_weight FROM (
  SELECT CAST(SUM(CASE WHEN "Left" = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0,
         CAST(SUM(CASE WHEN "Left" = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1 FROM clean)"""))
def q_pos_weight(spark, sf):
    return P.pos_weight(clean(spark, sf), "Left")


@register("balanced_weights", with_(CLEAN, """
SELECT Customer_ID, "Left",
       CASE WHEN "Left" = 1 THEN n / (n1 * 2) ELSE n / (n0 * 2) END AS weight
FROM clean, (SELECT COUNT(*) AS n, SUM(CASE WHEN "Left" = 0 THEN 1 ELSE 0 END) AS n0,
                    SUM(CASE WHEN "Left" = 1 THEN 1 ELSE 0 END) AS n1 FROM clean) t"""))
def q_balanced_weights(spark, sf):
    return P.balanced_weights(clean(spark, sf), "Left", "Customer_ID")


# ---- A9-A11, U2 ------------------------------------------------------------

QSETS = {"Salary": [0, 0.25, 0.5, 0.75, 1], "Balance": [0, 0.5, 1], "Score": [0, 0.2, 0.4, 0.6, 0.8, 1]}


@register("quantiles", with_(CLEAN, _union([
    f"SELECT '{c}' AS variable, CAST({p} AS DOUBLE) AS p, ROUND(quantile_cont({c}, {p}), 6) AS value FROM clean"
    for c, ps in QSETS.items() for p in ps])))
def q_quantiles(spark, sf):
    d = clean(spark, sf)
    out = None
    for c, ps in QSETS.items():
        q = quantiles(d, c, ps).select(F.lit(c).alias("variable"), "p", "value")
        out = q if out is None else out.unionByName(q)
    return out


def _box_sql(src, value_sql, by_sql):
    by_list = ", ".join(by_sql)
    on = " AND ".join(f"d.{b} = f.{b}" for b in by_sql)
    return f"""
, bx AS (SELECT {by_list}, CAST({value_sql} AS DOUBLE) AS x FROM {src}),
bq AS (SELECT {by_list}, ROUND(quantile_cont(x, 0.25), 6) AS q1, ROUND(quantile_cont(x, 0.5), 6) AS median,
              ROUND(quantile_cont(x, 0.75), 6) AS q3 FROM bx GROUP BY {by_list}),
bf AS (SELECT *, ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper_fence
       FROM bq)
SELECT {", ".join("f." + b for b in by_sql)}, q1, median, q3, lower_fence, upper_fence,
       MIN(CASE WHEN x >= lower_fence AND x <= upper_fence THEN x END) AS lower_whisker,
       MAX(CASE WHEN x >= lower_fence AND x <= upper_fence THEN x END) AS upper_whisker,
       CAST(SUM(CASE WHEN x >= lower_fence AND x <= upper_fence THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
       COUNT(*) AS n
FROM bx d JOIN bf f ON {on}
GROUP BY ALL"""


@register("box_by_class", "WITH " + CLEAN + _box_sql("clean", "Age", ['"Left"']))
def q_box_by_class(spark, sf):
    return P.box_stats(clean(spark, sf), "Age", "Left")


_BOX5 = ["Balance", "Salary", "Score", "Age", "Tenure"]
_MELT5 = _union([f"SELECT Source, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM clean" for c in _BOX5])


@register("box_by_source", "WITH " + CLEAN + f", m5 AS ({_MELT5})" + _box_sql("m5", "value", ["variable", "Source"]))
def q_box_by_source(spark, sf):
    long = P.melt(clean(spark, sf), ["Source"], _BOX5)
    return P.box_stats(long, "value", ["variable", "Source"])


@register("box_outlier_rows", "WITH " + CLEAN + """,
qq AS (SELECT Source, quantile_cont(Salary, 0.25) AS q1, quantile_cont(Salary, 0.75) AS q3 FROM clean GROUP BY Source)
SELECT clean.Source, Customer_ID, Salary FROM clean JOIN qq USING (Source)
WHERE Salary < ROUND(q1 - 1.5 * (q3 - q1), 6) OR Salary > ROUND(q3 + 1.5 * (q3 - q1), 6)""")
def q_box_outlier_rows(spark, sf):
    """The points of the box plot of salary by branch."""
    return P.box_outliers(clean(spark, sf), "Salary", "Source")


_MELT6 = _union([f"SELECT \"Left\", '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM clean" for c in NUM6])


@register("box_facets", "WITH " + CLEAN + f", m6 AS ({_MELT6})" + _box_sql("m6", "value", ["variable", '"Left"']))
def q_box_facets(spark, sf):
    return P.box_facets(clean(spark, sf), NUM6, "Left")


@register("corr_matrix", with_(CLEAN, _union([
    f"SELECT '{a}' AS var1, '{b}' AS var2, ROUND(corr(CAST({_q(a)} AS DOUBLE), CAST({_q(b)} AS DOUBLE)), 6) AS corr "
    "FROM clean" for i, a in enumerate(CORR8) for j, b in enumerate(CORR8) if i < j])))
def q_corr_matrix(spark, sf):
    return P.corr_matrix(clean(spark, sf), CORR8)


@register("melt", with_(CLEAN, _MELT6))
def q_melt(spark, sf):
    return P.melt(clean(spark, sf), ["Left"], NUM6)


# ---- B1-B8 -----------------------------------------------------------------

def _cut_sql(col, start, width, extra):
    mx = f"(SELECT MAX(CAST({col} AS DOUBLE)) FROM clean)"
    idx = f"FLOOR((CAST({col} AS DOUBLE) - {start}) / {width})"
    ok = f"(CAST({col} AS DOUBLE) >= {start} AND {idx} < FLOOR(({mx} + {extra} - {start}) / {width}))"
    lo = f"CASE WHEN {ok} THEN {start} + {idx} * {width} END"
    hi = f"CASE WHEN {ok} THEN {start} + ({idx} + 1) * {width} END"
    return lo, hi


def _fmt_sql(e):
    return f"CASE WHEN {e} = FLOOR({e}) THEN CAST(CAST(FLOOR({e}) AS BIGINT) AS VARCHAR) ELSE CAST({e} AS VARCHAR) END"


def _cut_select(col, start, width, extra):
    lo, hi = _cut_sql(col, start, width, extra)
    return (f"{lo} AS bin_lo, {hi} AS bin_hi, "
            f"'[' || {_fmt_sql('(' + lo + ')')} || ',' || {_fmt_sql('(' + hi + ')')} || ')' AS bin")


@register("cut_age", with_(CLEAN, f"""
SELECT bin, bin_lo, bin_hi, COUNT(*) AS n FROM (SELECT {_cut_select('Age', 0, 5, 5)} FROM clean) GROUP BY ALL"""))
def q_cut_age(spark, sf):
    d = B.cut_width(clean(spark, sf), "Age", 0, 5, extra=5)
    return P.count_by(d, ["bin", "bin_lo", "bin_hi"])


def _bin_rate_sql(col):
    return with_(CLEAN, f"""
SELECT bin, bin_lo, bin_hi, "Left", n, n / SUM(n) OVER (PARTITION BY bin, bin_lo, bin_hi) AS share FROM (
  SELECT bin, bin_lo, bin_hi, "Left", COUNT(*) AS n
  FROM (SELECT {_cut_select(col, 0, 10000, 0)}, "Left" FROM clean) GROUP BY ALL)""")


@register("salary_bin_rate", _bin_rate_sql("Salary"))
def q_salary_bin_rate(spark, sf):
    d = B.cut_width(clean(spark, sf), "Salary", 0, 10000)
    return B.bin_rate(d, ["bin", "bin_lo", "bin_hi"], "Left")


@register("balance_bin_rate", _bin_rate_sql("Balance"))
def q_balance_bin_rate(spark, sf):
    d = B.cut_width(clean(spark, sf), "Balance", 0, 10000)
    return B.bin_rate(d, ["bin", "bin_lo", "bin_hi"], "Left")


@register("score_bin_rate", with_(CLEAN, """
, st AS (SELECT MIN(CAST(Score AS DOUBLE)) AS mn, MAX(CAST(Score AS DOUBLE)) AS mx FROM clean),
sb AS (SELECT "Left", CAST(GREATEST(0, LEAST(19, CEIL((CAST(Score AS DOUBLE) - mn) / ((mx - mn) / 20)) - 1)) AS INTEGER) AS k,
              mn, mx FROM clean, st),
sl AS (SELECT "Left", k AS bin_idx,
              ROUND(CASE WHEN k = 0 THEN mn - (mx - mn) / 1000 ELSE mn + k * ((mx - mn) / 20) END, 6) AS bin_lo,
              ROUND(CASE WHEN k = 19 THEN mx + (mx - mn) / 1000 ELSE mn + (k + 1) * ((mx - mn) / 20) END, 6) AS bin_hi
       FROM sb)
SELECT bin_idx, bin_lo, bin_hi, "Left", n, n / SUM(n) OVER (PARTITION BY bin_idx, bin_lo, bin_hi) AS share
FROM (SELECT bin_idx, bin_lo, bin_hi, "Left", COUNT(*) AS n FROM sl GROUP BY ALL)"""))
def q_score_bin_rate(spark, sf):
    d = B.cut_n(clean(spark, sf), "Score", 20)
    return B.bin_rate(d, ["bin_idx", "bin_lo", "bin_hi"], "Left")


_KEYP = [0, 0.25, 0.5, 0.75, 1]


@register("key_bins", with_(CLEAN, """
SELECT p, value, round_even(value, 0) AS label,
       CASE WHEN value >= 0 AND FLOOR(value / 10000) < FLOOR((SELECT MAX(Salary) FROM clean) / 10000)
            THEN FLOOR(value / 10000) * 10000 END AS bin_lo
FROM (""" + _union([f"SELECT CAST({p} AS DOUBLE) AS p, ROUND(quantile_cont(Salary, {p}), 6) AS value FROM clean"
                    for p in _KEYP]) + ")"))
def q_key_bins(spark, sf):
    return B.key_bins(clean(spark, sf), "Salary", [0, 0.25, 0.5, 0.75, 1])


def _hw_sql(col, w, by):
    k = f"CAST(CEIL((CAST({col} AS DOUBLE) - {w} / 2) / {w}) AS BIGINT)"
    sel_by = (by + ", ") if by else ""
    return with_(CLEAN, f"""
SELECT {sel_by}CAST(k * {w} AS DOUBLE) AS center, CAST((k - 0.5) * {w} AS DOUBLE) AS lo,
       CAST((k + 0.5) * {w} AS DOUBLE) AS hi, COUNT(*) AS n
FROM (SELECT {sel_by}{k} AS k FROM clean) GROUP BY ALL""")


@register("hist_width_age", _hw_sql("Age", 1, '"Left"'))
def q_hist_width_age(spark, sf):
    return B.hist_width(clean(spark, sf), "Age", 1, "Left")


@register("hist_width_balance", _hw_sql("Balance", 10000, None))
def q_hist_width_balance(spark, sf):
    return B.hist_width(clean(spark, sf), "Balance", 10000)


@register("hist_bins", with_(CLEAN, """
, st AS (SELECT MIN(CAST(Age AS DOUBLE)) AS mn, (MAX(CAST(Age AS DOUBLE)) - MIN(CAST(Age AS DOUBLE))) / 29 AS w
       FROM clean)
SELECT "Left", k, ROUND(mn + k * w, 6) AS center, COUNT(*) AS n
FROM (SELECT "Left", CAST(GREATEST(0, CEIL((CAST(Age AS DOUBLE) - mn - w / 2) / w)) AS INTEGER) AS k, mn, w
      FROM clean, st)
GROUP BY "Left", k, mn, w"""))
def q_hist_bins(spark, sf):
    return B.hist_bins(clean(spark, sf), "Age", 30, "Left")


def _sturges_sql(src, col):
    return f"""
st AS (SELECT MIN(CAST({col} AS DOUBLE)) AS mn, MAX(CAST({col} AS DOUBLE)) AS mx, COUNT({col}) AS n FROM {src}),
p0 AS (SELECT *, (mx - mn) / CEIL(log2(n) + 1) AS cell FROM st),
p1 AS (SELECT *, pow(10.0, FLOOR(log10(cell))) AS base FROM p0),
p2 AS (SELECT *, CASE WHEN 2 * base - cell < 1.5 * (cell - base) THEN 2 * base ELSE base END AS u2 FROM p1),
p3 AS (SELECT *, CASE WHEN u2 = 2 * base AND 5 * base - cell < 2.75 * (cell - u2) THEN 5 * base ELSE u2 END AS u5
       FROM p2),
p4 AS (SELECT *, CASE WHEN u5 = 5 * base AND 10 * base - cell < 1.5 * (cell - u5) THEN 10 * base ELSE u5 END AS unit
       FROM p3),
p5 AS (SELECT *, FLOOR(mn / unit + 1e-10) AS ns0 FROM p4),
p6 AS (SELECT *, CASE WHEN ns0 * unit > mn + 1e-10 * unit THEN ns0 - 1 ELSE ns0 END AS ns FROM p5),
hs AS (SELECT CAST(GREATEST(0, CEIL((CAST({col} AS DOUBLE) - ns * unit) / unit) - 1) AS INTEGER) AS k,
              ns * unit AS s, unit AS u, n AS nn FROM {src}, p6 WHERE {col} IS NOT NULL)
SELECT k, ROUND(s + k * u, 6) AS lo, ROUND(s + k * u + u, 6) AS hi, COUNT(*) AS n,
       ROUND(COUNT(*) / (nn * u), 12) AS density
FROM hs GROUP BY k, s, u, nn"""


@register("hist_sturges_score", with_(CLEAN + "," + _sturges_sql("ded", "Score").split("\nSELECT k,")[0],
                                      "SELECT k," + _sturges_sql("ded", "Score").split("\nSELECT k,")[1]))
def q_hist_sturges_score(spark, sf):
    return B.hist_sturges(deduped(spark, sf), "Score")


@register("hist_sturges_salary", with_(CLEAN + "," + _sturges_sql("clean", "Salary").split("\nSELECT k,")[0],
                                       "SELECT k," + _sturges_sql("clean", "Salary").split("\nSELECT k,")[1]))
def q_hist_sturges_salary(spark, sf):
    return B.hist_sturges(clean(spark, sf), "Salary")


def _kde_sql(col, by, shared):
    by_sel = f"{by}, " if by else ""
    by_grp = f"GROUP BY {by}" if by else ""
    join_on = f"ON v.{by} = p.{by}" if by else "ON TRUE"
    if shared:
        lo, hi = "(SELECT MIN(CAST({c} AS DOUBLE)) FROM clean)".format(c=col), \
            "(SELECT MAX(CAST({c} AS DOUBLE)) FROM clean)".format(c=col)
    else:
        lo, hi = "mn - 3 * h", "mx + 3 * h"
    return with_(CLEAN, f"""
, ks AS (SELECT {by_sel}COUNT(*) AS n, stddev_samp(CAST({col} AS DOUBLE)) AS sd,
                MIN(CAST({col} AS DOUBLE)) AS mn, MAX(CAST({col} AS DOUBLE)) AS mx,
                ROUND(quantile_cont(CAST({col} AS DOUBLE), 0.25), 6) AS q1,
                ROUND(quantile_cont(CAST({col} AS DOUBLE), 0.75), 6) AS q3 FROM clean {by_grp}),
kb AS (SELECT *, 0.9 * CASE WHEN LEAST(sd, (q3 - q1) / 1.34) > 0 THEN LEAST(sd, (q3 - q1) / 1.34)
                           WHEN sd > 0 THEN sd WHEN ABS(mn) > 0 THEN ABS(mn) ELSE 1 END
                  * pow(CAST(n AS DOUBLE), -0.2) AS h FROM ks),
kp AS (SELECT *, {lo} AS glo, {hi} AS ghi FROM kb),
kv AS (SELECT {by_sel}CAST({col} AS DOUBLE) AS x, COUNT(*) AS c FROM clean GROUP BY ALL),
kg AS (SELECT p.*, i, glo + i * ((ghi - glo) / 511) AS gx FROM kp p, range(512) t(i))
SELECT {('p.' + by + ', ') if by else ''}CAST(i AS INTEGER) AS i, ROUND(gx, 6) AS x,
       ROUND(SUM(c * exp(-0.5 * ((gx - v.x) / h) * ((gx - v.x) / h))) / (n * h * sqrt(2 * pi())), 12) AS density
FROM kv v JOIN kg p {join_on}
GROUP BY {('p.' + by + ', ') if by else ''}i, gx, n, h""")


@register("kde_base", _kde_sql("Score", None, False))
def q_kde_base(spark, sf):
    return kde(clean(spark, sf), "Score")


@register("kde_by_class", _kde_sql("Age", '"Left"', True))
def q_kde_by_class(spark, sf):
    return kde(clean(spark, sf), "Age", "Left")
