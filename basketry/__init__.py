"""basketry: product recommendation analytics as Spark DataFrame jobs.

sources/    raw tables (CSV/Parquet), the driver-table mapping, the model store
functions/  column expressions and text helpers (built-in Spark functions only)
operators/  the operators of the inventory, DataFrame in, DataFrame out
plans/      the training job and the registered queries with their SQL oracle
streaming/  serving a stream of requests with the batch operators
"""
