"""DuckDB SQL building blocks for the oracle queries.

The driver registers the parquet tables as views; these CTEs rebuild the
churn fixture and the cleaning chain in plain SQL, independently of the
Spark code, so that every Spark plan is checked against a second engine.
"""

from __future__ import annotations

FEATURES = ["Salary", "Balance", "Tenure", "Score", "Age", "Products_in_Use", "Gender"]
RAW_COLS = ["Customer_ID", "Source", "Gender", "Age", "Tenure", "Score", "Salary", "Balance",
            "Products_in_Use", '"Left"']

BASE = """o_agg AS (
  SELECT o_custkey, COUNT(*) AS n, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents,
         COUNT(DISTINCT o_orderpriority) AS prio,
         MIN(o_orderdate) AS first_d, MAX(o_orderdate) AS last_d
  FROM orders GROUP BY o_custkey),
cb AS (
  SELECT c_custkey AS Customer_ID,
       CAST(1 + c_custkey % 3 AS INTEGER) AS Source,
       CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
       CAST(18 + (c_custkey * 37) % 63 AS INTEGER) AS Age,
       CAST(YEAR(last_d) - YEAR(first_d) AS INTEGER) AS Tenure,
       CAST(350 + (c_custkey * 7919) % 505 AS INTEGER) AS Score,
       CAST((cents - cents % n) / n AS DOUBLE) / 100 AS Salary,
       CASE WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS Balance,
       CAST(prio AS INTEGER) AS Products_in_Use,
       CASE WHEN last_d < TIMESTAMP '2000-08-01 00:00:00' THEN 1 ELSE 0 END AS "Left",
       CASE WHEN 18 + (c_custkey * 37) % 63 + 15 * (c_nationkey % 2) - 6 * prio
                 + (c_custkey * 104729) % 61 > 80 THEN 1 ELSE 0 END AS Left_planted
  FROM customer JOIN o_agg ON c_custkey = o_custkey)"""

RAW = BASE + """,
craw0 AS (
  SELECT Customer_ID, Source, Gender,
         CASE WHEN Customer_ID % 41 = 0 THEN CAST(NULL AS INTEGER) ELSE Age END AS Age,
         Tenure, Score,
         CASE WHEN Customer_ID % 499 = 7 THEN CAST(1e21 AS DOUBLE) ELSE Salary END AS Salary,
         Balance, Products_in_Use, "Left"
  FROM cb),
craw AS (SELECT * FROM craw0 UNION ALL SELECT * FROM craw0 WHERE Customer_ID % 53 = 0)"""

ENC = RAW + """,
enc AS (
  SELECT Customer_ID, Source,
         CAST(CASE WHEN Gender IS NULL THEN NULL WHEN Gender = 'Male' THEN 1 ELSE 0 END AS INTEGER) AS Gender,
         Age, Tenure, Score, Salary, Balance, Products_in_Use, "Left"
  FROM craw)"""

NOMISS_WHERE = ("Customer_ID IS NOT NULL AND Source IS NOT NULL AND Gender IS NOT NULL AND Age IS NOT NULL "
                "AND Tenure IS NOT NULL AND Score IS NOT NULL AND Salary IS NOT NULL AND NOT isnan(Salary) "
                "AND Balance IS NOT NULL AND NOT isnan(Balance) AND Products_in_Use IS NOT NULL "
                "AND \"Left\" IS NOT NULL")

CLEAN = ENC + f""",
nomiss AS (SELECT * FROM enc WHERE {NOMISS_WHERE}),
ded AS (SELECT DISTINCT * FROM nomiss),
rng AS (SELECT * FROM ded WHERE Score BETWEEN 350 AND 850),
sq AS (SELECT ROUND(quantile_cont(Salary, 0.25), 6) AS q1, ROUND(quantile_cont(Salary, 0.75), 6) AS q3 FROM rng),
sf AS (SELECT q1, q3, q3 - q1 AS iqr, ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower,
              ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper FROM sq),
clean AS (SELECT rng.* FROM rng, sf WHERE Salary >= sf.lower AND Salary <= sf.upper)"""


def with_(ctes: str, body: str) -> str:
    return "WITH " + ctes + "\n" + body


def md5_hex(seed, key_sql: str) -> str:
    return f"md5('{seed}' || ':' || CAST({key_sql} AS VARCHAR))"


def md5_uniform(seed, key_sql: str) -> str:
    return f"(CAST(('0x' || substr({md5_hex(seed, key_sql)}, 1, 8)) AS BIGINT) / 4294967296.0)"
