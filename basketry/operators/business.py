"""Business metrics named by the reference (K1-K4); its README names them, no code
defines them, so the definitions here are ours and stated in each docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators import clean
from basketry.sources.tables import RawTables


def average_order_value(raw: RawTables, delivered: str = clean.DEFAULT_DELIVERED) -> DataFrame:
    """K1: order-level AOV (mean per-order payment total, a missing total counts
    0) per customer state and purchase month."""
    orders = clean.order_facts(raw, delivered)
    return (orders.groupBy("customer_state",
                           F.date_format("order_time", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 C.exact_avg(F.coalesce(F.col("payment_value"), F.lit(0.0))).alias("aov")))


def repeat_purchase_rate(raw: RawTables, delivered: str = clean.DEFAULT_DELIVERED) -> DataFrame:
    """K2: share of users with two or more distinct delivered orders."""
    orders = clean.order_facts(raw, delivered)
    per_user = orders.groupBy("user_id").agg(F.countDistinct("order_id").alias("_orders"))
    return per_user.agg(
        F.count(F.lit(1)).alias("users"),
        F.sum((F.col("_orders") >= 2).cast("long")).alias("repeat_users")
    ).withColumn("repeat_rate", F.col("repeat_users") / F.col("users"))


def click_through_rate(events: DataFrame) -> DataFrame:
    """K3: clicks / views per day (null on a day without views)."""
    day = F.to_date("ts").alias("day")
    per = events.groupBy(day).agg(
        F.sum((F.col("event_type") == "view").cast("long")).alias("views"),
        F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"))
    return per.withColumn("ctr", F.when(F.col("views") > 0,
                                        F.col("clicks") / F.col("views")))


def conversion_rate(events: DataFrame) -> DataFrame:
    """K4: per day, users with a view, how many of them also purchased that day,
    and the rate."""
    day = F.to_date("ts").alias("day")
    per = events.groupBy(day, "user_id").agg(
        F.max((F.col("event_type") == "view").cast("int")).alias("_v"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("_p"))
    return (per.where(F.col("_v") == 1).groupBy("day")
            .agg(F.count(F.lit(1)).alias("viewers"),
                 F.sum("_p").cast("long").alias("converted"))
            .withColumn("conversion_rate", F.col("converted") / F.col("viewers")))
