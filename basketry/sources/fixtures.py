"""The driver's TPC-H-style tables mapped onto the marketplace inputs.

Each mapped table has the columns the library reads (see ``tables.RawTables``).
The same mapping is given as SQL views (``SQL_VIEWS``) so that DuckDB can
repeat every query on the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.tables import RawTables

# Fixed values of the mapping (FIXTURES.md §3).
DELIVERED_STATUS = "F"          # orders with o_orderstatus = 'F' count as delivered
UNTRANSLATED_TYPE = "STANDARD"  # the one category with no English translation
REVIEWED_MAX_QUANTITY = 25.0    # lines of up to this quantity carry a review
REVIEW_SCORE_BY_FLAG = {"A": 5.0, "N": 4.0, "R": 2.0}
PRICE_BUCKET_THRESHOLDS = (3000.0, 5000.0)  # in place of 50 and 200


def _review_score(flag: Column) -> Column:
    expr = None
    for k, v in REVIEW_SCORE_BY_FLAG.items():
        expr = (F.when(flag == k, F.lit(v)) if expr is None
                else expr.when(flag == k, F.lit(v)))
    return expr


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def driver_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """Lazy mapped tables; nothing is read until an action runs."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = _read(spark, sf_dir, "customer")
    # nation is the fixed 25-row dimension: the planner broadcasts it by file size.
    customers = (customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
                 .select(F.col("c_custkey").alias("customer_id"),
                         F.col("c_custkey").alias("customer_unique_id"),
                         F.col("n_name").alias("customer_state"),
                         F.col("c_nationkey").alias("customer_zip_code_prefix")))
    orders = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"))
    lineitem = _read(spark, sf_dir, "lineitem")
    order_items = lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("shipping_limit_date"))
    part = _read(spark, sf_dir, "part")
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.col("p_size").alias("product_weight_g"))
    translation = (part.where(F.col("p_type") != UNTRANSLATED_TYPE)
                   .select(F.col("p_type").alias("product_category_name"),
                           F.lower("p_type").alias("product_category_name_english"))
                   .distinct())
    payments = lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
        .alias("payment_value"))
    reviews = (lineitem.where(F.col("l_quantity") <= REVIEWED_MAX_QUANTITY)
               .select(F.col("l_orderkey").alias("order_id"),
                       _review_score(F.col("l_returnflag")).alias("review_score")))
    sellers = _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"))
    geolocation = _read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("geolocation_zip_code_prefix"),
        F.col("n_name").alias("geolocation_state"))
    return RawTables(customers=customers, orders=orders, products=products,
                     order_items=order_items, payments=payments, reviews=reviews,
                     translation=translation, sellers=sellers, geolocation=geolocation)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events")


def customer_requests(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """One recommendation request per customer: (user_id, state, n)."""
    t = driver_tables(spark, sf_dir)
    return t.customers.select(F.col("customer_unique_id").alias("user_id"),
                              F.col("customer_state").alias("state"),
                              F.lit(n).alias("n"))


def product_requests(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """One similar-products request per catalog part: (product_id, n)."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"),
                                               F.lit(n).alias("n"))


# The same mapping for the DuckDB oracle: a WITH-list of views.
SQL_VIEWS = f"""
customers_m AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id,
         n_name AS customer_state, c_nationkey AS customer_zip_code_prefix
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
orders_m AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp
  FROM orders),
items_m AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_extendedprice / l_quantity AS price,
         l_shipdate AS shipping_limit_date
  FROM lineitem),
products_m AS (
  SELECT p_partkey AS product_id, p_type AS product_category_name, p_size AS product_weight_g
  FROM part),
translation_m AS (
  SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
  FROM part WHERE p_type <> '{UNTRANSLATED_TYPE}'),
payments_m AS (
  SELECT l_orderkey AS order_id, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS payment_value
  FROM lineitem),
reviews_m AS (
  SELECT l_orderkey AS order_id,
         CASE l_returnflag {' '.join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in REVIEW_SCORE_BY_FLAG.items())} END
           AS review_score
  FROM lineitem WHERE l_quantity <= {REVIEWED_MAX_QUANTITY}),
sellers_m AS (SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix FROM supplier),
geolocation_m AS (SELECT n_nationkey AS geolocation_zip_code_prefix, n_name AS geolocation_state FROM nation)
"""
