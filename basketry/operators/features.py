"""Implicit interaction scores.

Everything downstream of the row weights is computed from one partial
aggregation at (user, product, state) grain, so a hot user, product or pair is
combined map-side before any shuffle; no window ever holds a raw hot group.

score(row) = purchase + review boost + value boost + repeat boost(pair rows)
Because the repeat boost is constant within a (user, product) pair,
max(score) over a pair = purchase + repeat + max(review + value), and sums over
rows split into a sum of the row-level part plus rows * repeat boost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import columns as C


def mean_payment(master: DataFrame) -> DataFrame:
    """A3: global mean of ``payment_value`` over item rows (one row)."""
    return master.agg(C.exact_avg(F.col("payment_value")).alias("mean_payment"))


def weighted_rows(master: DataFrame, purchase_weight: int = C.PURCHASE_WEIGHT,
                  review_boost: int = C.REVIEW_BOOST,
                  review_threshold: float = C.REVIEW_THRESHOLD,
                  value_boost: int = C.VALUE_BOOST) -> DataFrame:
    """P3-P5 + J13: row weights; the global mean enters as a scalar subquery."""
    mean = mean_payment(master).scalar()
    return master.withColumns({
        "purchase_weight": F.lit(purchase_weight),
        "review_weight": C.review_weight(F.col("review_score"), review_boost,
                                         review_threshold),
        "value_weight": C.value_weight(F.col("payment_value"), mean, value_boost)})


def pair_state_facts(master: DataFrame, **weights) -> DataFrame:
    """Rows aggregated to (user, product, state): row count, sum of the row-level
    part of the score, and its maximum. Rows without a user belong to no pair. The single row-level shuffle of the
    feature stage; partial aggregation combines hot keys map-side."""
    rows = weighted_rows(master, **weights).where(F.col("user_id").isNotNull())
    base = F.col("purchase_weight") + F.col("review_weight") + F.col("value_weight")
    return (rows.groupBy("user_id", "product_id", "customer_state")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(base).alias("base_sum"),
                 F.max(F.col("review_weight") + F.col("value_weight")).alias("max_boost"),
                 F.max("purchase_weight").alias("purchase_weight")))


def pair_facts(pair_state: DataFrame, repeat_boost: int = C.REPEAT_BOOST) -> DataFrame:
    """A4 + A5 at (user, product) grain: pair rows, repeat weight, max score, score sum."""
    agg = (pair_state.groupBy("user_id", "product_id")
           .agg(F.sum("n_rows").alias("user_product_count"),
                F.sum("base_sum").alias("base_sum"),
                F.max("max_boost").alias("max_boost"),
                F.max("purchase_weight").alias("purchase_weight")))
    rep = C.repeat_weight(F.col("user_product_count"), repeat_boost)
    return agg.select(
        "user_id", "product_id", "user_product_count",
        rep.alias("repeat_weight"),
        (F.col("purchase_weight") + F.col("max_boost") + rep).cast("int")
        .alias("interaction_score"),
        (F.col("base_sum") + F.col("user_product_count") * rep).cast("long")
        .alias("score_sum"))


def interactions(master: DataFrame, **weights) -> DataFrame:
    """A5: the interaction table (user_id, product_id, interaction_score)."""
    repeat = weights.pop("repeat_boost", C.REPEAT_BOOST)
    return pair_facts(pair_state_facts(master, **weights), repeat).select(
        "user_id", "product_id", "interaction_score")


def state_score_sums(pair_state: DataFrame, repeat_boost: int = C.REPEAT_BOOST) -> DataFrame:
    """Score sums at (user, product, state) grain with the pair-level repeat weight.
    The window groups hold one row per state of a pair, so they stay small."""
    w = Window.partitionBy("user_id", "product_id")
    rep = C.repeat_weight(F.sum("n_rows").over(w), repeat_boost)
    return pair_state.select("user_id", "product_id", "customer_state",
                             (F.col("base_sum") + F.col("n_rows") * rep).alias("score_sum"))


def scored_rows(master: DataFrame, repeat_boost: int = C.REPEAT_BOOST, **weights) -> DataFrame:
    """P6 + P7 + J7: every master row with its four weights and interaction score.

    The pair row count is aggregated (map-side combined) and joined back on the
    pair; a hot pair is a skewed join key, which AQE's skew join splits."""
    rows = weighted_rows(master, **weights)
    counts = (rows.groupBy("user_id", "product_id")
              .agg(F.count(F.lit(1)).alias("user_product_count"))
              .select("user_id", "product_id",
                      C.repeat_weight(F.col("user_product_count"), repeat_boost)
                      .alias("repeat_weight")))
    out = rows.join(counts, ["user_id", "product_id"], "left")
    return out.withColumn(
        "interaction_score",
        (F.col("purchase_weight") + F.col("review_weight") + F.col("value_weight")
         + F.col("repeat_weight")).cast("int"))


def summed_interactions(rows: DataFrame) -> DataFrame:
    """Duplicate (user, product) entries add up, as in a sparse matrix build. For a
    whole master, ``pair_facts`` has the same sum as ``score_sum`` without scored rows."""
    return (rows.where(F.col("user_id").isNotNull()).groupBy("user_id", "product_id")
            .agg(F.sum("interaction_score").cast("long").alias("interaction_score")))


def purchase_history(master: DataFrame) -> DataFrame:
    """Distinct (user, product) purchases. ``pair_history`` has the same rows where the
    pair facts are at hand."""
    return master.where(F.col("user_id").isNotNull()).select("user_id", "product_id").distinct()


def pair_history(pairs: DataFrame) -> DataFrame:
    """A16 from ``pair_facts``, which hold every purchased pair once."""
    return pairs.select("user_id", "product_id")
