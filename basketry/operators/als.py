"""Implicit ALS (M3, M4) on MLlib.

The reference's library uses the stored value itself as confidence; MLlib uses
1 + alpha * r. With alpha = 1 and rating = score - 1 both give confidence = score
(all scores are >= 5, so every preference is 1). MLlib's regularisation scales
with the number of ratings per user, so factors never match the reference's;
results are checked by invariants and ranking metrics.

Top-N with purchases removed is exact and does not score every product: products are
visited in blocks of falling norm, a user stops when no further block can reach the N-th
score, and purchased products are skipped inside the blocks (``mips``).
"""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators import encode as enc
from basketry.operators import mips
from basketry.session import checkpoint_dir, cut_lineage

# The reference's ALS settings.
FACTORS = 100
REGULARIZATION = 0.1
ITERATIONS = 20
SEED = 42

CHECKPOINT_EVERY = 1        # iterations between cuts of the factors' lineage
COLLECT_SECONDS = 10.0


@contextmanager
def _collected(spark, seconds: float = COLLECT_SECONDS):
    """Runs the driver's garbage collection now and then: Spark deletes the shuffle files of a
    table once the driver has collected the table, and a driver with memory to spare may not
    do so during a whole fit."""
    done = threading.Event()

    def run():
        while not done.wait(seconds):
            spark.sparkContext._jvm.System.gc()
    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    try:
        yield
    finally:
        done.set()
        worker.join()
        spark.sparkContext._jvm.System.gc()


@dataclass
class ALSRecommender:
    model: ALSModel
    users: DataFrame     # (user_id, user_code)
    products: DataFrame  # (product_id, product_code)


def fit(interactions: DataFrame, factors: int = FACTORS, reg: float = REGULARIZATION,
        iterations: int = ITERATIONS, seed: int = SEED,
        score_col: str = "interaction_score", blocks: int | None = None) -> ALSRecommender:
    """M1 + M3: encode ids, fit implicit ALS on (user, product, score - 1).
    User and product factors are split into ``blocks`` blocks (default: the
    session's parallelism, so every core solves a block each half-iteration).

    Every half iteration sends the factors to all blocks that need them; with a checkpoint
    each iteration the files of an iteration can go when the next one is done, so the disk
    holds the factors of a few half iterations, not of all."""
    spark = interactions.sparkSession
    blocks = blocks or spark.sparkContext.defaultParallelism
    checkpoint_dir(spark)  # ALS cuts its lineage there
    users = enc.fit_encoder(interactions, "user_id", "user_code")
    products = enc.fit_encoder(interactions, "product_id", "product_code")
    ratings = (interactions.join(users, "user_id").join(products, "product_id")
               .select("user_code", "product_code",
                       (F.col(score_col) - 1).cast("float").alias("rating")))
    ratings = cut_lineage(ratings)
    als = ALS(rank=factors, maxIter=iterations, regParam=reg, alpha=1.0,
              implicitPrefs=True, seed=seed, userCol="user_code", itemCol="product_code",
              ratingCol="rating", coldStartStrategy="drop", nonnegative=False,
              numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=CHECKPOINT_EVERY)
    with _collected(spark):
        model = als.fit(ratings)
    return ALSRecommender(model, users, products)


def normal_residuals(rec: ALSRecommender, interactions: DataFrame, reg: float = REGULARIZATION,
                     score_col: str = "interaction_score") -> DataFrame:
    """(user_code, n_items, residual): how far each user's factors x are from solving the
    user's normal equations given the product factors y and confidences c,

        (sum_all y y' + sum_bought (c - 1) y y' + reg n I) x = sum_bought c y,

    as |left - right| / |right|. The sums over the purchases are aggregates per user and
    factor; the sum over all products is one small matrix."""
    rank = rec.model.rank
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    users = rec.model.userFactors.select(F.col("id").alias("user_code"), F.col("features").alias("x"))
    items = cut_lineage(rec.model.itemFactors.select(F.col("id").alias("product_code"), F.col("features").alias("y")))
    rows = (interactions.join(rec.users, "user_id").join(rec.products, "product_id")
            .join(users, "user_code").join(items, "product_code")
            .select("user_code", "x", "y", F.col(score_col).cast("double").alias("c")).withColumn("d", dot))
    each = rows.select("user_code", "c", "d", F.posexplode("y").alias("at", "v")).groupBy("user_code", "at").agg(
        F.sum(((F.col("c") - 1) * F.col("d") - F.col("c")) * F.col("v")).alias("less"),
        F.sum(F.col("c") * F.col("v")).alias("right"), F.count(F.lit(1)).alias("n"))
    per = each.groupBy("user_code").agg(F.array_sort(F.collect_list(F.struct("at", "less", "right"))).alias("e"),
                                        F.max("n").alias("n_items"))
    gram = (items.select(F.posexplode("y").alias("i", "a"), "y").select("i", "a", F.posexplode("y").alias("j", "b"))
            .groupBy("i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("g")).collect())
    yy = np.zeros((rank, rank))
    for r in gram:
        yy[r.i, r.j] = r.g

    def run(batches):
        for b in batches:
            x = np.stack(b["x"].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, rank))
            less, right = (np.array([[e[k] for e in es] for es in b["e"]]).reshape(-1, rank) for k in ("less", "right"))
            left = x @ yy + less + reg * b["n_items"].to_numpy()[:, None] * x
            yield pd.DataFrame({"user_code": b["user_code"], "n_items": b["n_items"],
                                "residual": np.linalg.norm(left, axis=1) / np.linalg.norm(right, axis=1)})
    return per.join(users, "user_code").mapInPandas(run, "user_code int, n_items long, residual double")


REFERENCE_SWEEPS = 3


def reference_fit(interactions: DataFrame, sweeps: int = REFERENCE_SWEEPS, reg: float = REGULARIZATION,
                  score_col: str = "interaction_score") -> tuple[DataFrame, DataFrame]:
    """Users (user_id, f0, f1) and products (product_id, f0, f1) of implicit ALS with two
    factors: MLlib's objective, starting factors by arithmetic on the product id, every
    half sweep one aggregation of the exact normal equations (two unknowns, solved in
    place). Slow to converge and only two factors wide: a yardstick, not a model."""
    rows = cut_lineage(interactions.select("user_id", "product_id", F.col(score_col).cast("double").alias("c")))
    start = lambda f: (F.pmod(F.col("product_id") * f, F.lit(1000)) + 1) / F.lit(1000.0)
    items = rows.select("product_id").distinct().select("product_id", start(7919).alias("f0"), start(104729).alias("f1"))
    f0, f1, more = F.col("f0"), F.col("f1"), F.col("c") - 1
    users = None

    def half(given: DataFrame, other: str, own: str) -> DataFrame:
        given = cut_lineage(given)
        g = given.agg(F.sum(f0 * f0).alias("s00"), F.sum(f0 * f1).alias("s01"), F.sum(f1 * f1).alias("s11")).first()
        n = F.count(F.lit(1))
        sums = rows.join(given, other).groupBy(own).agg(
            (F.sum(more * f0 * f0) + n * reg + F.lit(g.s00)).alias("a00"), (F.sum(more * f0 * f1) + F.lit(g.s01)).alias("a01"),
            (F.sum(more * f1 * f1) + n * reg + F.lit(g.s11)).alias("a11"),
            F.sum(F.col("c") * f0).alias("b0"), F.sum(F.col("c") * f1).alias("b1"))
        det = F.col("a00") * F.col("a11") - F.col("a01") * F.col("a01")
        return sums.select(own, ((F.col("b0") * F.col("a11") - F.col("b1") * F.col("a01")) / det).alias("f0"),
                           ((F.col("b1") * F.col("a00") - F.col("b0") * F.col("a01")) / det).alias("f1"))
    for _ in range(sweeps):
        users = cut_lineage(half(items, "product_id", "user_id"))
        items = cut_lineage(half(users, "user_id", "product_id"))
    return users, items


_RECS = "user_id {}, rank int, product_id {}, als_score double"


def recommend(rec: ALSRecommender, requests: DataFrame, history: DataFrame,
              over_fetch: int = 2, report: dict | None = None) -> DataFrame:
    """M4 + J12: ([request_id], user_id, n) requests of known users -> (keys, rank,
    product_id, als_score), rank <= over_fetch * n, purchased products removed. A user is
    scored once, however many requests name them. ``report`` gets the scored pairs."""
    keys = [c for c in ("request_id", "user_id") if c in requests.columns]
    wanted = cut_lineage(requests.groupBy("user_id").agg((F.max("n") * over_fetch).alias("want"))
                         .join(rec.users, "user_id", "inner").where(F.col("want") > 0))
    if wanted.isEmpty():
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        recs = requests.sparkSession.createDataFrame([], _RECS.format(
            kind(rec.users, "user_id"), kind(rec.products, "product_id")))
    else:
        factors = rec.model.userFactors.withColumnRenamed("id", "user_code")
        bought = (history.select("user_id", "product_id").join(rec.users, "user_id").join(rec.products, "product_id")
                  .select("user_code", "product_code"))
        top = mips.top_products(wanted.join(factors, "user_code").select("user_code", "features", "want"),
                                rec.model.itemFactors, bought, report=report)
        w = Window.partitionBy("user_id").orderBy(F.col("als_score").desc(), "product_id")
        recs = cut_lineage(top.join(wanted.select("user_code", "user_id"), "user_code").join(rec.products, "product_code")
                           .withColumnRenamed("score", "als_score").withColumn("rank", F.row_number().over(w))
                           .select("user_id", "rank", "product_id", "als_score"))
    return (recs.join(requests.select(*keys, "n"), "user_id")
            .where(F.col("rank") <= F.col("n") * over_fetch)
            .select(*keys, "rank", "product_id", "als_score"))
