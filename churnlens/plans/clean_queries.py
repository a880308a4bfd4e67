"""Queries for section 3.1: load, tag, encode, missing, duplicates, ranges, fences."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import clean as C
from churnlens.plans.oracle_sql import CLEAN, ENC, RAW, with_
from churnlens.plans.registry import register
from churnlens.session import inputs_key, stored
from churnlens.sources.fixtures import branches, churn_raw
from churnlens.sources.io import tag_and_append


def raw(spark, sf):
    return churn_raw(spark, sf)


def encoded(spark, sf):
    return C.encode_gender(raw(spark, sf))


def no_missing(spark, sf):
    return C.drop_missing(encoded(spark, sf))


def deduped(spark, sf):
    return C.dedup(no_missing(spark, sf))


def in_range(spark, sf):
    return C.keep_range(deduped(spark, sf), "Score")


def clean(spark, sf):
    """The cleaned table as the analysis steps read it.

    Like the reference (clean once, write the output table, analyse that
    file), the chain runs once per session and input files, is written as
    Parquet to the shared checkpoint folder, and is read back. This also cuts
    the lineage the later jobs would otherwise recompute.
    """
    return stored(spark, "clean", inputs_key(spark, sf), lambda: C.clean_table(raw(spark, sf)))


@register("tag_append", with_(RAW, "SELECT * FROM craw"))
def q_tag_append(spark, sf):
    return tag_and_append(branches(spark, sf))


@register("encode_gender", with_(ENC, "SELECT * FROM enc"))
def q_encode_gender(spark, sf):
    return encoded(spark, sf)


@register("missing_report", with_(ENC, """
SELECT missing_rows, total_rows, missing_rows * 100 / total_rows AS missing_pct,
       round_even(missing_rows * 100 / total_rows, 2) AS missing_pct_r2
FROM (SELECT CAST(SUM(CASE WHEN Gender IS NULL OR Age IS NULL OR Tenure IS NULL OR Score IS NULL
                   OR Salary IS NULL OR isnan(Salary) OR Balance IS NULL OR isnan(Balance)
                   OR Products_in_Use IS NULL OR "Left" IS NULL OR Source IS NULL
                   OR Customer_ID IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_rows,
             COUNT(*) AS total_rows FROM enc)"""))
def q_missing_report(spark, sf):
    return C.missing_report(encoded(spark, sf))


@register("drop_missing", with_(CLEAN, "SELECT * FROM nomiss"))
def q_drop_missing(spark, sf):
    return no_missing(spark, sf)


@register("dup_count", with_(CLEAN, """
SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM ded) AS BIGINT) AS n_duplicates FROM nomiss"""))
def q_dup_count(spark, sf):
    return C.dup_count(no_missing(spark, sf))


@register("dup_groups", with_(CLEAN, """
SELECT *, COUNT(*) AS count FROM nomiss GROUP BY ALL HAVING COUNT(*) > 1"""))
def q_dup_groups(spark, sf):
    return C.dup_groups(no_missing(spark, sf))


@register("dup_rows", with_(CLEAN, """
SELECT * EXCLUDE (c, i) FROM (
  SELECT *, unnest(generate_series(2, c)) AS i
  FROM (SELECT *, COUNT(*) AS c FROM nomiss GROUP BY ALL HAVING COUNT(*) > 1))"""))
def q_dup_rows(spark, sf):
    return C.dup_rows(no_missing(spark, sf))


@register("dedup", with_(CLEAN, "SELECT * FROM ded"))
def q_dedup(spark, sf):
    return deduped(spark, sf)


@register("score_out_of_range", with_(CLEAN, "SELECT * FROM ded WHERE Score < 350 OR Score > 850"))
def q_score_oor(spark, sf):
    return C.out_of_range(deduped(spark, sf), "Score")


@register("score_out_of_range_count", with_(CLEAN, """
SELECT COUNT(*) AS n_out_of_range FROM ded WHERE Score < 350 OR Score > 850"""))
def q_score_oor_count(spark, sf):
    return C.out_of_range_count(deduped(spark, sf), "Score")


@register("score_positions", with_(CLEAN, """
SELECT position, Customer_ID, Score FROM (
  SELECT Customer_ID, Score, row_number() OVER (ORDER BY Customer_ID) AS position FROM ded)
WHERE Score < 350 OR Score > 850"""))
def q_score_positions(spark, sf):
    return C.out_of_range_positions(deduped(spark, sf), "Score", "Customer_ID")


@register("outlier_share", with_(CLEAN, """
SELECT category, n, n * 100 / total AS pct FROM (
  SELECT 'Outliers' AS category, CAST(SUM(CASE WHEN Score < 350 OR Score > 850 THEN 1 ELSE 0 END) AS BIGINT) AS n,
         COUNT(*) AS total FROM ded
  UNION ALL
  SELECT 'Regular Values', CAST(COUNT(*) - SUM(CASE WHEN Score < 350 OR Score > 850 THEN 1 ELSE 0 END) AS BIGINT),
         COUNT(*) FROM ded)"""))
def q_outlier_share(spark, sf):
    d = deduped(spark, sf)
    return C.share_report(d, (F.col("Score") < 350) | (F.col("Score") > 850))


@register("missing_share", with_(CLEAN, """
SELECT category, n, n * 100 / total AS pct FROM (
  SELECT 'Missing Rows' AS category, CAST(COUNT(*) - (SELECT COUNT(*) FROM nomiss) AS BIGINT) AS n,
         COUNT(*) AS total FROM enc
  UNION ALL
  SELECT 'Non-Missing Rows', (SELECT COUNT(*) FROM nomiss), COUNT(*) FROM enc)"""))
def q_missing_share(spark, sf):
    from churnlens.functions.expressions import any_missing
    d = encoded(spark, sf)
    return C.share_report(d, any_missing(d), ("Missing Rows", "Non-Missing Rows"))


@register("salary_fence", with_(CLEAN, "SELECT q1, q3, iqr, lower, upper FROM sf"))
def q_salary_fence(spark, sf):
    return C.iqr_fence(in_range(spark, sf), "Salary")


@register("salary_outliers", with_(CLEAN, """
SELECT rng.* FROM rng, sf WHERE Salary < sf.lower OR Salary > sf.upper"""))
def q_salary_outliers(spark, sf):
    return C.iqr_outliers(in_range(spark, sf), "Salary")


@register("salary_fence_drop", with_(CLEAN, "SELECT * FROM clean"))
def q_salary_fence_drop(spark, sf):
    return C.drop_iqr_outliers(in_range(spark, sf), "Salary")


@register("balance_fence_report", with_(CLEAN + """,
bq AS (SELECT ROUND(quantile_cont(Balance, 0.25), 6) AS q1, ROUND(quantile_cont(Balance, 0.75), 6) AS q3
       FROM clean),
bf AS (SELECT q1, q3, q3 - q1 AS iqr, ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower,
              ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper FROM bq)""", """
SELECT q1, q3, iqr, lower, upper,
       (SELECT COUNT(*) FROM clean, bf WHERE Balance < bf.lower OR Balance > bf.upper) AS n_outliers
FROM bf"""))
def q_balance_fence_report(spark, sf):
    return C.fence_report(clean(spark, sf), "Balance")


@register("clean_table", with_(CLEAN, "SELECT * FROM clean"))
def q_clean_table(spark, sf):
    return C.clean_table(raw(spark, sf))
