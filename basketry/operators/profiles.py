"""User and product profiles, time features.

The reference builds each profile from one group-by per feature and re-joins
them. Here each profile is one aggregation: the user profile first aggregates to
(user, category) -- a partial aggregation that combines hot users map-side -- and
then to user, where the favourite category is a ``min`` over (-count, category)
instead of a sort, so no window ever holds a user's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import columns as C


def _with_user(master: DataFrame) -> DataFrame:
    """Rows without a user belong to no group, as in the reference's grouping."""
    return master.where(F.col("user_id").isNotNull())


def user_profiles(master: DataFrame) -> DataFrame:
    """(user_id, total_purchases, avg_order_value, favorite_category, active_days)."""
    by_cat = (_with_user(master).groupBy("user_id", "category")
              .agg(F.count(F.lit(1)).alias("n"),
                   C.exact_sum(F.col("payment_value")).alias("pay_sum"),
                   F.count("payment_value").alias("pay_n"),
                   F.min("order_time").alias("first_t"),
                   F.max("order_time").alias("last_t")))
    fav = F.min(F.when(F.col("category").isNotNull(),
                       F.struct((-F.col("n")).alias("neg_n"), F.col("category"))))
    prof = (by_cat.groupBy("user_id")
            .agg(F.sum("n").alias("total_purchases"),                      # A6
                 (F.sum("pay_sum") / F.sum("pay_n")).cast("double")
                 .alias("avg_order_value"),                                 # A7
                 fav.alias("fav"),                                          # A8
                 F.min("first_t").alias("first_t"),
                 F.max("last_t").alias("last_t")))
    return prof.select(
        "user_id", "total_purchases", "avg_order_value",
        F.col("fav.category").alias("favorite_category"),
        (C.whole_days(F.col("first_t"), F.col("last_t")) + 1).cast("int")
        .alias("active_days"))  # A9


def product_profiles(master: DataFrame, price_col: str = "price") -> DataFrame:
    """(product_id, total_purchases, avg_price, avg_review_score, category).
    ``price_col="payment_value"`` gives the prototype's price (A17)."""
    return (master.groupBy("product_id")
            .agg(F.count(F.lit(1)).alias("total_purchases"),     # A10
                 C.exact_avg(F.col(price_col)).alias("avg_price"),  # A11 / A17
                 C.exact_avg(F.col("review_score")).alias("avg_review_score"),  # A12
                 F.min("category").alias("category")))           # A13


def time_features(master: DataFrame) -> DataFrame:
    """A18 + P14-P16: last purchase, whole days to the dataset maximum, weekday
    (Monday = 0) and month of the last purchase."""
    analysis = master.agg(F.max("order_time")).scalar()
    last = _with_user(master).groupBy("user_id").agg(F.max("order_time").alias("last_purchase_date"))
    return last.select(
        "user_id", "last_purchase_date",
        C.whole_days(F.col("last_purchase_date"), analysis).alias("recency_days"),
        C.weekday_monday0(F.col("last_purchase_date")).alias("purchase_dayofweek"),
        F.month("last_purchase_date").alias("purchase_month"))


def interaction_counts(master: DataFrame) -> DataFrame:
    """Rows per user (the routing input)."""
    return _with_user(master).groupBy("user_id").agg(F.count(F.lit(1)).alias("interaction_count"))
