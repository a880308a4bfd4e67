"""The churn table, derived from ``customer`` and ``orders``.

No churn extract ships with the test data, so the table is derived by rule
(see FIXTURES.md): every column is arithmetic on the customer key and the
customer's orders, so the same rows come out of Spark and of DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.sources.tables import read_table

# Fixed values of the fixture rule (FIXTURES.md section 3).
CUTOFF = "2000-08-01 00:00:00"
MISSING_AGE_MOD = 41
BIG_SALARY_MOD, BIG_SALARY_REM, BIG_SALARY = 499, 7, 1e21
DUP_MOD = 53

FEATURES = ["Salary", "Balance", "Tenure", "Score", "Age", "Products_in_Use", "Gender"]
LABEL = "Left"
KEY = "Customer_ID"


def churn_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with at least one order."""
    orders = read_table(spark, sf_dir, "orders",
                        ["o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate"])
    # map-side combine: one partial row per customer and input partition
    o = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.countDistinct("o_orderpriority").alias("prio"),
        F.min("o_orderdate").alias("first_d"),
        F.max("o_orderdate").alias("last_d"))
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    j = cust.join(o, cust.c_custkey == o.o_custkey)
    k = F.col("c_custkey")
    age = 18 + (k * 37) % 63
    left_planted = (age + 15 * (F.col("c_nationkey") % 2) - 6 * F.col("prio") + (k * 104729) % 61) > 80
    return j.select(
        k.alias("Customer_ID"),
        (1 + k % 3).cast("int").alias("Source"),
        F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        age.cast("int").alias("Age"),
        (F.year("last_d") - F.year("first_d")).cast("int").alias("Tenure"),
        (350 + (k * 7919) % 505).cast("int").alias("Score"),
        (((F.col("cents") - F.col("cents") % F.col("n")) / F.col("n")).cast("double") / 100).alias("Salary"),
        F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("Balance"),
        F.col("prio").cast("int").alias("Products_in_Use"),
        F.when(F.col("last_d") < F.lit(CUTOFF).cast("timestamp_ntz"), 1).otherwise(0).alias("Left"),
        F.when(left_planted, 1).otherwise(0).alias("Left_planted"),
    )


def churn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty variant: missing ages, a 1e21 salary, whole-row copies."""
    k = F.col("Customer_ID")
    d = (churn_base(spark, sf_dir).drop("Left_planted")
         .withColumn("Age", F.when(k % MISSING_AGE_MOD == 0, F.lit(None).cast("int")).otherwise(F.col("Age")))
         .withColumn("Salary", F.when(k % BIG_SALARY_MOD == BIG_SALARY_REM, F.lit(BIG_SALARY))
                     .otherwise(F.col("Salary"))))
    return d.unionByName(d.where(k % DUP_MOD == 0))


def branches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The three branch extracts: ``churn_raw`` split by ``Source``, tag removed."""
    raw = churn_raw(spark, sf_dir)
    return [raw.where(F.col("Source") == s).drop("Source") for s in (1, 2, 3)]
