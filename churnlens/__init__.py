"""churnlens: customer-churn analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; the heavy work runs
as Spark jobs (aggregations, joins, windows, Arrow-batched pandas functions).
"""

__version__ = "0.1.0"
