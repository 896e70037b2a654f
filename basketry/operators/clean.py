"""Cleaning and the item-level master table.

Join order is chosen for scale: everything keyed by order is joined at order level
first (orders x customers, per-order payment and review aggregates), so the large
item table is shuffled once on ``order_id`` and once on ``product_id``. The
translation is joined to the small product table, never to the item rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.session import bounded_broadcast, spread
from basketry.sources.tables import RawTables

DEFAULT_DELIVERED = "delivered"
MISSING_CATEGORY = "other"
PROTOTYPE_MISSING_CATEGORY = "Unknown"
REVIEW_FILL = 3.0
PAYMENT_FILL = 0.0
TRANSLATION_MAX_ROWS = 100_000

# The columns the prototype drops before its full-row de-duplication.
PROTOTYPE_DROP = [
    "customer_id", "order_status", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
    "shipping_limit_date", "seller_id", "price", "freight_value",
    "product_category_name", "product_name_lenght", "product_description_lenght",
    "product_photos_qty", "customer_zip_code_prefix", "review_id", "review_comment_title",
    "review_comment_message", "review_creation_date", "review_answer_timestamp",
    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]


def delivered_orders(orders: DataFrame, status: str = DEFAULT_DELIVERED) -> DataFrame:
    """P1 + P2: delivered orders only; purchase timestamp renamed to ``order_time``."""
    return (orders.where(F.col("order_status") == F.lit(status))
            .withColumnRenamed("order_purchase_timestamp", "order_time"))


def payment_per_order(payments: DataFrame) -> DataFrame:
    """A1: payment sum per order, added as exact decimals, so it does not depend on the
    order of the rows (null keys never join, so they are dropped)."""
    return (payments.where(F.col("order_id").isNotNull())
            .groupBy("order_id")
            .agg(C.exact_sum(F.col("payment_value")).cast("double").alias("payment_value")))


def review_per_order(reviews: DataFrame) -> DataFrame:
    """A2: mean review score per order."""
    return (reviews.where(F.col("order_id").isNotNull())
            .groupBy("order_id").agg(F.avg("review_score").alias("review_score")))


def users(customers: DataFrame) -> DataFrame:
    """The unique customer id becomes ``user_id``."""
    return customers.select("customer_id",
                            F.col("customer_unique_id").alias("user_id"),
                            "customer_state")


def categorized_products(products: DataFrame, translation: DataFrame,
                         missing: str = MISSING_CATEGORY) -> DataFrame:
    """J4 + P8: English category, missing translation or category -> ``missing``."""
    tr = bounded_broadcast(
        translation.select("product_category_name", "product_category_name_english"),
        TRANSLATION_MAX_ROWS)
    return (products.select("product_id", "product_category_name")
            .join(tr, "product_category_name", "left")
            .select("product_id",
                    F.coalesce(F.col("product_category_name_english"), F.lit(missing))
                    .alias("category")))


def order_facts(raw: RawTables, delivered: str = DEFAULT_DELIVERED) -> DataFrame:
    """Order-level side of the master: J1 (inner customers), J5, J6 (left, pre-aggregated)."""
    orders = delivered_orders(raw.orders, delivered).select("order_id", "customer_id",
                                                            "order_time")
    return (orders.join(users(raw.customers), "customer_id", "inner")
            .join(payment_per_order(raw.payments), "order_id", "left")
            .join(review_per_order(raw.reviews), "order_id", "left"))


def build_master(raw: RawTables, delivered: str = DEFAULT_DELIVERED,
                 missing_category: str = MISSING_CATEGORY) -> DataFrame:
    """The item-level master table, one row per order item."""
    items = raw.order_items.select("order_id", "order_item_id", "product_id", "price")
    master = (items.join(order_facts(raw, delivered), "order_id", "inner")          # J2
              .join(categorized_products(raw.products, raw.translation,
                                         missing_category), "product_id", "inner"))  # J3
    return master.select(
        "order_id", "order_item_id", "user_id", "product_id", "customer_state",
        "order_time", "price", "category",
        F.coalesce(F.col("payment_value"), F.lit(PAYMENT_FILL)).alias("payment_value"),
        F.coalesce(F.col("review_score"), F.lit(REVIEW_FILL)).alias("review_score"))


def prototype_joined(raw: RawTables, delivered: str = DEFAULT_DELIVERED,
                     reviews: DataFrame | None = None) -> DataFrame:
    """The notebook's join chain (raw reviews left, payment totals inner) with
    its renames, before any fill. Each item row is repeated once per review row
    of its order, as in the notebook. Customers are joined to orders, not to items, and
    both order-level joins come last, so the rows leave dealt by order."""
    orders = delivered_orders(raw.orders, delivered)
    reviews = raw.reviews if reviews is None else reviews
    products = raw.products.join(
        bounded_broadcast(raw.translation, TRANSLATION_MAX_ROWS),
        "product_category_name", "left")
    payments = payment_per_order(raw.payments)
    keys = ["order_id", "customer_id", "product_id"]
    columns = keys + [c for df in (orders, raw.order_items, products, raw.customers, reviews, payments)
                      for c in df.columns if c not in keys]
    items = (orders.join(raw.customers, "customer_id")
             .join(raw.order_items, "order_id")
             .join(products, "product_id"))
    # each item is repeated for its order's reviews
    joined = (spread(items, "order_id")
              .join(reviews, "order_id", "left")
              .join(payments, "order_id")
              .select(*columns))
    return (joined.withColumnRenamed("customer_unique_id", "user_id")
            .withColumnRenamed("product_category_name_english", "category"))


def prototype_master(raw: RawTables, delivered: str = DEFAULT_DELIVERED,
                     missing_category: str = PROTOTYPE_MISSING_CATEGORY) -> DataFrame:
    """J10 + P10 + P11: fills, the listed columns dropped, full-row de-duplication.

    Only ``review_score`` of a review survives the drop, so joining the distinct
    (order, score) pairs gives the same de-duplicated rows without the
    items x reviews fan-out of a large order."""
    scores = raw.reviews.select("order_id", "review_score").distinct()
    filled = prototype_joined(raw, delivered, scores).withColumns({
        "review_score": F.coalesce(F.col("review_score"), F.lit(REVIEW_FILL)),
        "category": F.coalesce(F.col("category"), F.lit(missing_category))})
    return filled.drop(*PROTOTYPE_DROP).dropDuplicates()
