"""Column expressions (P3-P7, P12-P16): all built-in, no Python UDF, so they stay
inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interaction weights of the reference (purchase, review, value, repeat).
PURCHASE_WEIGHT = 5
REVIEW_BOOST = 2
REVIEW_THRESHOLD = 4.0
VALUE_BOOST = 1
REPEAT_BOOST = 3

# Price bands. ``src`` variant: < low -> Low, <= high -> Mid, else High.
# Notebook variant: <= low -> low-price, <= high -> mid-price, else high-price.
SRC_BUCKET_LABELS = ("Low", "Mid", "High")
NOTEBOOK_BUCKET_LABELS = ("low-price", "mid-price", "high-price")
REFERENCE_THRESHOLDS = (50.0, 200.0)


def review_weight(review_score: Column, boost: int = REVIEW_BOOST,
                  threshold: float = REVIEW_THRESHOLD) -> Column:
    """Boost when the review score is at least the threshold."""
    return F.when(review_score >= F.lit(threshold), F.lit(boost)).otherwise(F.lit(0))


def value_weight(payment_value: Column, mean_payment: Column,
                 boost: int = VALUE_BOOST) -> Column:
    """P5: boost when the payment is strictly above the global mean."""
    return F.when(payment_value > mean_payment, F.lit(boost)).otherwise(F.lit(0))


def repeat_weight(pair_rows: Column, boost: int = REPEAT_BOOST) -> Column:
    """Boost when the (user, product) pair has more than one row."""
    return F.when(pair_rows > 1, F.lit(boost)).otherwise(F.lit(0))


def price_bucket(price: Column, thresholds=REFERENCE_THRESHOLDS,
                 labels=SRC_BUCKET_LABELS, low_inclusive: bool = False) -> Column:
    """Three bands; a null price fails both tests and lands in the top band."""
    low, high = thresholds
    first = price <= F.lit(low) if low_inclusive else price < F.lit(low)
    return (F.when(first, F.lit(labels[0]))
            .when(price <= F.lit(high), F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def score_text(score: Column) -> Column:
    """Round half to even to one decimal, printed like a float: 4.0, 4.2."""
    return F.format_number(F.bround(score, 1), 1)


def content_text(category: Column, bucket: Column, score: Column | None = None) -> Column:
    """Category (null -> ''), bucket and, for the ``src`` variant, the rounded
    review score, separated by single spaces."""
    parts = [F.coalesce(category, F.lit("")), bucket]
    if score is not None:
        parts.append(F.regexp_replace(score_text(score), ",", ""))
    return F.concat_ws(" ", *parts)


def weekday_monday0(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour days from ``start`` to ``end``."""
    return F.timestamp_diff("DAY", start, end)


def exact_sum(c: Column, scale: int = 9) -> Column:
    """Sum of the inputs rounded to ``scale`` places (half up, by the cast), as an exact decimal."""
    return F.sum(c.cast(f"decimal(30,{scale})"))


def exact_avg(c: Column, scale: int = 9) -> Column:
    """Mean whose sum is exact: inputs rounded to ``scale`` places (half up, by the cast) and
    summed as decimals, so the result does not depend on partitioning or summation order."""
    return F.avg(c.cast(f"decimal(30,{scale})")).cast("double")
