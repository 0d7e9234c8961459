"""Independent DuckDB oracles for the Spark operators.

Written from the operator semantics in relational style (unnest + group +
window), not transcribed from the Spark code. Tables are the driver's
pre-registered views; each query derives its inputs itself (CTEs).
"""
