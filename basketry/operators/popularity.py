"""Popularity model.

Scores are sums of interaction scores per product and per (state, product),
computed from the pair-grain facts. Rankings are bounded top-k tables: the
global one is a TakeOrdered, the state one a window with a group limit, so only
k rows per state cross the shuffle. Requests are answered by joining them to a
small per-state list (size states x 3 max_n, checked before it is broadcast).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators import features as feat
from basketry.session import bounded_broadcast, cut_lineage

MAX_N = 50               # the request bound of the reference API
GLOBAL_KEY = "\u0000global"  # list key for requests without a known state
LIST_MAX_ROWS = 1_000_000   # broadcast only below this many (narrow) rows


def global_scores(pair: DataFrame) -> DataFrame:
    """Sum of interaction scores per product (pair facts, or sums of them -> product)."""
    return (pair.groupBy("product_id")
            .agg(F.sum("score_sum").cast("long").alias("score")))


def state_sums(pair_state: DataFrame) -> DataFrame:
    """Sum per (state, product), those without a state too."""
    return (feat.state_score_sums(pair_state)
            .groupBy(F.col("customer_state").alias("state"), "product_id")
            .agg(F.sum("score_sum").cast("long").alias("score")))


def state_scores(pair_state: DataFrame) -> DataFrame:
    """Sum per (state, product); rows without a state are left out."""
    return state_sums(pair_state).where(F.col("state").isNotNull())


def scores_from_master(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9 fit: (global scores, state scores) from the item-level master."""
    ps = feat.pair_state_facts(master)
    return global_scores(feat.pair_facts(ps)), state_scores(ps)


def global_ranking(scores: DataFrame, k: int) -> DataFrame:
    """Top-k products by (score desc, product_id), with their rank 1..k."""
    top = scores.orderBy(F.col("score").desc(), F.col("product_id")).limit(k)
    # k rows only: a single-partition window over them is bounded.
    w = Window.orderBy(F.col("score").desc(), F.col("product_id"))
    return top.withColumn("rank", F.row_number().over(w))


def state_ranking(scores: DataFrame, k: int) -> DataFrame:
    """Per state, top-k by (score desc, product_id)."""
    w = Window.partitionBy("state").orderBy(F.col("score").desc(), F.col("product_id"))
    return (scores.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def _ranked_array() -> Column:
    return F.sort_array(F.collect_list(F.struct("rank", "product_id")))


def popularity_lists(global_sc: DataFrame, state_sc: DataFrame,
                     max_n: int = MAX_N) -> DataFrame:
    """T3 as a table: for every state, the list a request with that state gets
    (state top-n, then the global ranking without the state's products), and the
    plain global list under ``GLOBAL_KEY``. Columns (list_key, product_id, pos).

    Needs only each state's top ``max_n`` and the global top ``2 max_n``: a state
    list shorter than n is complete, and at most n-1 of its products can sit in
    the global top 2n. The global top list enters every state's row as one
    scalar array (2 max_n entries), so no state x product pairs are joined."""
    g_top = global_ranking(global_sc, 2 * max_n)
    g_arr = g_top.agg(_ranked_array().alias("g")).scalar()
    s_lists = (state_ranking(state_sc, max_n).groupBy("state")
               .agg(_ranked_array().alias("items")))  # <= max_n per state
    s_lists = s_lists.withColumn("g", g_arr).withColumn(
        "fill", F.filter("g", lambda g: ~F.array_contains(
            F.col("items.product_id"), g["product_id"])))  # J15
    own = (s_lists.select("state", F.explode("items").alias("it"))
           .select("state", F.col("it.product_id").alias("product_id"),
                   F.col("it.rank").alias("pos")))
    fill = (s_lists.select("state", F.size("items").alias("s_len"),
                           F.posexplode("fill").alias("i", "it"))
            .select("state", F.col("it.product_id").alias("product_id"),
                    (F.col("s_len") + F.col("i") + 1).alias("pos")))
    glob = g_top.select(F.lit(GLOBAL_KEY).alias("state"), "product_id",
                        F.col("rank").alias("pos"))
    return (own.unionByName(fill).unionByName(glob)
            .where(F.col("pos") <= max_n)
            .select(F.col("state").alias("list_key"), "product_id",
                    F.col("pos").cast("int").alias("pos")))


@dataclass
class PopularityModel:
    """M9: product and state scores plus the served lists (written once, small).
    The lists hold ``max_n`` products each; longer requests get lists of their own."""
    global_scores: DataFrame
    state_scores: DataFrame
    lists: DataFrame
    max_n: int = MAX_N

    def lists_for(self, n: int, keys: DataFrame) -> DataFrame:
        """Lists of at least ``n`` products (as far as there are products) for the given
        keys (list_key), of ``max_n`` for all others."""
        if n <= self.max_n:
            return self.lists
        states = self.state_scores.join(keys.select(F.col("list_key").alias("state")), "state", "left_semi")
        long = popularity_lists(self.global_scores, states, n).join(keys, "list_key", "left_semi")
        return cut_lineage(self.lists.join(keys, "list_key", "left_anti").unionByName(long))


def fit(master: DataFrame, max_n: int = MAX_N, pair_state: DataFrame | None = None) -> PopularityModel:
    """M9 fit. ``pair_state``: the master's ``pair_state_facts``, where they are at hand."""
    # both scores are read again for longer lists: a row per product, and per state and product.
    # A product's score is the sum of those of its states and of its rows without one.
    sums = cut_lineage(state_sums(feat.pair_state_facts(master) if pair_state is None else pair_state))
    s = sums.where(F.col("state").isNotNull())
    g = cut_lineage(global_scores(sums.select("product_id", F.col("score").alias("score_sum"))))
    # The lists are a model artifact of (states + 1) x max_n rows: written once to
    # the shared checkpoint folder, so their size is known before any broadcast.
    lists = cut_lineage(popularity_lists(g, s, max_n))
    return PopularityModel(g, s, lists, max_n)


def with_list_key(requests: DataFrame, lists: DataFrame) -> DataFrame:
    """A request uses its state's list when the state is non-empty and known."""
    known = bounded_broadcast(
        lists.where(F.col("list_key") != GLOBAL_KEY).select(
            F.col("list_key").alias("_known")).distinct(), LIST_MAX_ROWS)
    r = requests.join(known, requests["state"] == known["_known"], "left")
    return r.withColumn("list_key", F.when(
        F.col("_known").isNotNull() & (F.col("state") != ""), F.col("state"))
        .otherwise(F.lit(GLOBAL_KEY))).drop("_known")


def request_keys(requests: DataFrame) -> list[str]:
    """What names a request: its id where it has one, and its user."""
    return [c for c in ("request_id", "user_id") if c in requests.columns]


def recommend(requests: DataFrame, model: PopularityModel, with_columns=None) -> DataFrame:
    """([request_id], user_id, state, n) requests -> (keys, rank, product_id),
    rank <= n, for any n. ``with_columns`` may add columns to the lists before they are
    expanded to requests, while they are small."""
    longest = requests.agg(F.max("n")).first()[0] or 0
    keyed = with_list_key(requests, model.lists)
    lists = model.lists
    if longest > model.max_n:
        keyed = cut_lineage(keyed)
        lists = model.lists_for(longest, cut_lineage(keyed.where(F.col("n") > model.max_n).select("list_key").distinct()))
    extra = []
    if with_columns is not None:
        lists = cut_lineage(with_columns(lists))
        extra = [c for c in lists.columns if c not in ("list_key", "product_id", "pos")]
    small = bounded_broadcast(lists, LIST_MAX_ROWS)
    return (keyed.join(small, "list_key")
            .where(F.col("pos") <= F.col("n"))
            .select(*request_keys(requests), F.col("pos").cast("int").alias("rank"),
                    "product_id", *extra))


def top_bought(master: DataFrame, k: int = 10) -> DataFrame:
    """The k products with most item rows, ties by id."""
    counts = master.groupBy("product_id").agg(F.count(F.lit(1)).alias("purchases"))
    top = counts.orderBy(F.col("purchases").desc(), "product_id").limit(k)
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("purchases").desc(), "product_id")))
