"""Logistic inference (L1-L4): coefficients, standard errors, odds ratios.

The fit is Spark's IRLS (``GeneralizedLinearRegression``, binomial/logit,
no penalty): each iteration is one distributed pass that aggregates the
normal equations, so only a (features x features) matrix reaches the driver.
The result tables have one row per feature.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.prepare import fit_scaler
from churnlens.operators.report import top_k

# Two-sided 95 % normal quantile and the significance ladder.
Z95 = 1.959964
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def _design(df: DataFrame, features, label: str, scale: bool, decimals=None):
    d = fit_scaler(df, features, decimals).transform(df) if scale else df
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return va.transform(d).select("features", F.col(label).cast("double").alias("label"))


def _fit(df, features, label, scale, decimals):
    glr = GeneralizedLinearRegression(family="binomial", link="logit", regParam=0.0, maxIter=100, tol=1e-10)
    return glr.fit(_design(df, features, label, scale, decimals))


def logit_inference(df: DataFrame, features, label: str = "Left", scale: bool = True,
                    decimals=None) -> DataFrame:
    """L1: feature, coefficient, std_error, z, p_value, odds_ratio, CI, significant, stars."""
    m = _fit(df, features, label, scale, decimals)
    s = m.summary
    se, z, p = s.coefficientStandardErrors, s.tValues, s.pValues     # intercept last
    names = list(features) + ["const"]
    coefs = list(m.coefficients) + [m.intercept]
    rows = []
    for i, name in enumerate(names):
        b, e = float(coefs[i]), float(se[i])
        stars = next((st for lim, st in STARS if p[i] < lim), "")
        rows.append((name, b, e, float(z[i]), float(p[i]), math.exp(b), math.exp(b - Z95 * e),
                     math.exp(b + Z95 * e), bool(p[i] < 0.05), stars))
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, std_error double, z double, "
                                                 "p_value double, odds_ratio double, ci_lower double, "
                                                 "ci_upper double, significant boolean, stars string")


def chi2_sf(x: float, k: int) -> float:
    """Chi-square upper tail = regularised upper incomplete gamma Q(k/2, x/2)."""
    a, x = k / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    if x < a + 1:                       # series for P, then Q = 1 - P
        term = total = 1.0 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1 - a                       # continued fraction for Q (modified Lentz)
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def logit_summary(df: DataFrame, features, label: str = "Left", scale: bool = True, decimals=None) -> DataFrame:
    """L2: n, degrees of freedom, log-likelihoods, pseudo R2 and LR test."""
    m = _fit(df, features, label, scale, decimals)
    s = m.summary
    ll, ll0 = -s.deviance / 2, -s.nullDeviance / 2
    k = len(features)
    llr = 2 * (ll - ll0)
    row = (int(s.numInstances), k, int(s.residualDegreeOfFreedom), ll, ll0, 1 - ll / ll0, llr, chi2_sf(llr, k),
           float(s.aic), int(s.numIterations))
    return df.sparkSession.createDataFrame([row], "n long, df_model int, df_resid long, loglik double, "
                                                  "loglik_null double, pseudo_r2 double, llr double, "
                                                  "llr_pvalue double, aic double, iterations int")


def logit_fit(df: DataFrame, features, label: str = "Left", scale: bool = True, decimals=None):
    """L3: plain unpenalised logistic regression for scoring (a pyspark.ml model)."""
    lr = LogisticRegression(regParam=0.0, standardization=False, maxIter=1000, tol=1e-10)
    return lr.fit(_design(df, features, label, scale, decimals))


def odds_ratio_order(table: DataFrame, k: int = 10, order: str = "asc") -> DataFrame:
    """T4: features by distance of the odds ratio from 1 (``asc`` = smallest
    effect first, as the reference chart does); first k."""
    d = F.abs(F.col("odds_ratio") - 1)
    t = table.where(F.col("feature") != "const").withColumn("distance_from_1", d)
    return top_k(t, "distance_from_1", k, ascending=order == "asc")


def effect_text(table: DataFrame) -> DataFrame:
    """L4: one sentence per significant feature, largest effect first.

    The sentence gives the change of the odds for a step of 1 in the feature,
    which is one standard deviation where the features were scaled.
    """
    sig = table.where(F.col("significant") & (F.col("feature") != "const"))
    inc = F.col("coefficient") > 0
    mag = F.when(inc, (F.col("odds_ratio") - 1) * 100).otherwise((1 - F.col("odds_ratio")) * 100)
    txt = F.format_string("%s: one step up %s the odds of leaving by %.1f %%",
                          F.col("feature"), F.when(inc, F.lit("raises")).otherwise(F.lit("lowers")), mag)
    return sig.select("feature", F.abs(F.col("odds_ratio") - 1).alias("effect_magnitude"), txt.alias("text")) \
        .orderBy(F.col("effect_magnitude").desc())
