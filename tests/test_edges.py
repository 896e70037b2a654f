"""Hand-made edge frames (FIXTURES.md §4): one behaviour each."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators import clean, content, evaluate, profiles, router
from basketry.operators import features as feat
from basketry.operators import popularity as pop
from basketry.sources.tables import RawTables

MASTER_SCHEMA = ("order_id string, order_item_id int, user_id string, product_id string, "
                 "customer_state string, order_time timestamp_ntz, price double, "
                 "category string, payment_value double, review_score double")
T0 = dt.datetime(2020, 1, 1, 10, 0, 0)


def master(spark, rows):
    full = []
    for r in rows:
        d = dict(order_id="o1", order_item_id=1, user_id="u1", product_id="p1",
                 customer_state="SP", order_time=T0, price=10.0, category="toys",
                 payment_value=10.0, review_score=3.0)
        d.update(r)
        full.append(d)
    return spark.createDataFrame(full, MASTER_SCHEMA)


def raw_tables(spark, orders, items, payments=(), reviews=(), products=None, translation=None,
               customers=None):
    customers = customers or [("c1", "u1", "SP")]
    products = products or [("p1", "brinquedos"), ("p2", "cama")]
    translation = translation or [("brinquedos", "toys"), ("cama", "bed")]
    return RawTables(
        customers=spark.createDataFrame(
            customers, "customer_id string, customer_unique_id string, customer_state string"),
        orders=spark.createDataFrame(
            [(o, c, s, T0) for o, c, s in orders],
            "order_id string, customer_id string, order_status string, "
            "order_purchase_timestamp timestamp_ntz"),
        order_items=spark.createDataFrame(
            items, "order_id string, order_item_id int, product_id string, price double"),
        payments=spark.createDataFrame(list(payments), "order_id string, payment_value double"),
        reviews=spark.createDataFrame(list(reviews), "order_id string, review_score double"),
        products=spark.createDataFrame(
            products, "product_id string, product_category_name string"),
        translation=spark.createDataFrame(
            translation, "product_category_name string, product_category_name_english string"))


def test_repeat_within_one_order(spark):
    m = master(spark, [dict(order_item_id=1), dict(order_item_id=2)])
    rows = feat.scored_rows(m).collect()
    assert {r.repeat_weight for r in rows} == {3}
    inter = feat.interactions(m).collect()
    assert [(r.user_id, r.product_id, r.interaction_score) for r in inter] == [("u1", "p1", 8)]


def test_review_boundary(spark):
    m = master(spark, [dict(review_score=4.0, product_id="a"),
                       dict(review_score=3.9, product_id="b", order_id="o2")])
    got = {r.product_id: r.review_weight for r in feat.scored_rows(m).collect()}
    assert got == {"a": 2, "b": 0}


def test_payment_equal_to_mean_gets_no_boost(spark):
    m = master(spark, [dict(payment_value=10.0, product_id="a"),
                       dict(payment_value=10.0, product_id="b", order_id="o2")])
    assert {r.value_weight for r in feat.scored_rows(m).collect()} == {0}


def test_global_mean_counts_item_rows(spark):
    m = master(spark, [dict(order_id="o1", product_id="a", payment_value=30.0),
                       dict(order_id="o1", product_id="b", payment_value=30.0),
                       dict(order_id="o2", product_id="c", payment_value=0.0)])
    assert feat.mean_payment(m).collect()[0][0] == pytest.approx(20.0)


def test_price_buckets(spark):
    df = spark.createDataFrame([(50.0,), (200.0,), (None,), (49.99,), (200.01,)], "p double")
    src = [r[0] for r in df.select(C.price_bucket(F.col("p"))).collect()]
    assert src == ["Mid", "Mid", "High", "Low", "High"]
    nb = [r[0] for r in df.select(C.price_bucket(
        F.col("p"), labels=C.NOTEBOOK_BUCKET_LABELS, low_inclusive=True)).collect()]
    assert nb == ["low-price", "mid-price", "high-price", "low-price", "high-price"]


def test_master_fills_and_review_mean(spark):
    raw = raw_tables(
        spark,
        orders=[("o1", "c1", "delivered"), ("o2", "c1", "delivered"), ("o3", "c1", "shipped")],
        items=[("o1", 1, "p1", 5.0), ("o2", 1, "p2", 7.0), ("o3", 1, "p1", 1.0),
               ("o2", 2, "p3", 2.0)],
        payments=[("o1", 4.0), ("o1", 6.0)],
        reviews=[("o1", 5.0), ("o1", 2.0)],
        products=[("p1", "brinquedos"), ("p2", "sem_traducao"), ("p3", None)])
    rows = {(r.order_id, r.product_id): r for r in clean.build_master(raw).collect()}
    assert set(rows) == {("o1", "p1"), ("o2", "p2"), ("o2", "p3")}   # o3 not delivered
    assert rows[("o1", "p1")].review_score == 3.5
    assert rows[("o1", "p1")].payment_value == 10.0
    assert rows[("o2", "p2")].review_score == 3.0                   # no review
    assert rows[("o2", "p2")].payment_value == 0.0                  # no payment
    assert rows[("o2", "p2")].category == "other"                   # no translation
    assert rows[("o2", "p3")].category == "other"                   # null category


def test_null_state_in_global_not_in_states(spark):
    m = master(spark, [dict(customer_state=None, product_id="x"),
                       dict(customer_state="SP", product_id="y", order_id="o2")])
    g, s = pop.scores_from_master(m)
    assert {r.product_id for r in g.collect()} == {"x", "y"}
    assert {(r.state, r.product_id) for r in s.collect()} == {("SP", "y")}


def _pop_model(spark):
    # state AA buys a and b; the rest is bought in BB with falling popularity
    rows = [dict(customer_state="AA", product_id="a", order_id="o1", user_id="u1"),
            dict(customer_state="AA", product_id="b", order_id="o2", user_id="u2")]
    for i, p in enumerate(["g1", "g2", "g3", "g4", "a"]):
        for j in range(6 - i):
            rows.append(dict(customer_state="BB", product_id=p, order_id=f"x{i}{j}",
                             user_id=f"v{i}{j}"))
    return pop.fit(master(spark, rows), max_n=5)


def test_short_state_list_filled_from_global(spark):
    model = _pop_model(spark)
    req = spark.createDataFrame([("n1", "AA", 5)], "user_id string, state string, n int")
    got = [r.product_id for r in pop.recommend(req, model).orderBy("rank").collect()]
    # own list first (a before b by score, then id), then global without a and b
    assert got[:2] == ["a", "b"]
    assert got[2:] == ["g1", "g2", "g3"]


def test_unknown_null_empty_state_use_global(spark):
    model = _pop_model(spark)
    req = spark.createDataFrame([("n1", "ZZ", 3), ("n2", None, 3), ("n3", "", 3)],
                                "user_id string, state string, n int")
    got = {}
    for r in pop.recommend(req, model).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.product_id)
    glob = [r.product_id for r in pop.global_ranking(model.global_scores, 3).orderBy("rank")
            .collect()]
    assert got == {"n1": glob, "n2": glob, "n3": glob}


def test_fill_cut_before_history_may_stay_short(spark):
    model = _pop_model(spark)
    req = spark.createDataFrame([("u9", "ZZ", 3)], "user_id string, state string, n int")
    top3 = [r.product_id for r in pop.recommend(req, model).collect()]
    history = spark.createDataFrame([("u9", p) for p in top3], "user_id string, product_id string")
    als_recs = spark.createDataFrame([], "user_id string, rank int, product_id string")
    out = router.warm_fill(als_recs, req, model, history).collect()
    assert out == []


def test_unknown_product_enrichment(spark):
    recs = spark.createDataFrame([("u1", 1, "nope")], "user_id string, rank int, product_id string")
    prof = spark.createDataFrame([("p1", 3, 10.0, 4.0, "toys")],
                                 "product_id string, total_purchases long, avg_price double, "
                                 "avg_review_score double, category string")
    r = router.enrich(recs, prof).collect()[0]
    assert (r.category, r.price, r.review_score, r.popularity_sales) == ("unknown", 0.0, 0.0, 0)


def test_favourite_category_tie_is_alphabetical(spark):
    m = master(spark, [dict(category="toys", product_id="a"),
                       dict(category="bed", product_id="b", order_id="o2")])
    r = profiles.user_profiles(m).collect()[0]
    assert r.favorite_category == "bed"


def test_active_days_counts_full_days(spark):
    m = master(spark, [dict(order_time=dt.datetime(2020, 1, 1, 23, 0)),
                       dict(order_time=dt.datetime(2020, 1, 2, 1, 0), order_id="o2")])
    assert profiles.user_profiles(m).collect()[0].active_days == 1


def _texts(spark, rows):
    return spark.createDataFrame(rows, "product_id string, text string")


def test_same_signature_never_returns_self_and_ties_by_id(spark):
    t = _texts(spark, [("p3", "toys Low"), ("p1", "toys Low"), ("p2", "toys Low"),
                       ("q1", "bed High")])
    model = content.fit(t, max_n=5)
    req = spark.createDataFrame([("p2", 5)], "product_id string, n int")
    got = [(r.similar_id, r.similarity) for r in content.similar(model, req).orderBy("rank").collect()]
    assert got == [("p1", 1.0), ("p3", 1.0)]      # q1 shares no token: left out


def test_other_category_matches_by_bucket_only(spark):
    t = _texts(spark, [("a", "other Low 4.0"), ("b", "toys Low 3.5"), ("c", "toys High 3.0")])
    model = content.fit(t, max_n=5)
    req = spark.createDataFrame([("a", 5)], "product_id string, n int")
    assert [r.similar_id for r in content.similar(model, req).collect()] == ["b"]


def test_fewer_products_than_n_and_unknown_product(spark):
    t = _texts(spark, [("a", "toys Low"), ("b", "toys High")])
    model = content.fit(t, max_n=10)
    req = spark.createDataFrame([("a", 10), ("zz", 10)], "product_id string, n int")
    got = [(r.product_id, r.similar_id) for r in content.similar(model, req).collect()]
    assert got == [("a", "b")]


def test_repeated_word_is_one_token_row(spark):
    w = content.tfidf(_texts(spark, [("a", "toys toys Low")]), stop_words=[]).collect()
    assert sorted((r.token, r.tf) for r in w) == [("low", 1), ("toys", 2)]


def test_ranking_metrics_by_hand(spark):
    recs = spark.createDataFrame([("u", 1, "a"), ("u", 2, "x"), ("u", 3, "b")],
                                 "user_id string, rank int, product_id string")
    truth = spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, product_id string")
    users = spark.createDataFrame([("u",)], "user_id string")
    r = evaluate.user_metrics(recs, truth, users, k=3).collect()[0]
    assert r.precision == pytest.approx(2 / 3)
    assert r.recall == pytest.approx(1.0)
    assert r.average_precision == pytest.approx((1 + 2 / 3) / 2)


def test_csv_quoted_newline(spark, tmp_dir):
    from basketry.sources.tables import SCHEMAS, null_tokens_to_null, read_csv_table
    path = f"{tmp_dir}/reviews.csv"
    with open(path, "w") as f:
        f.write("review_id,order_id,review_score,review_comment_title,review_comment_message,"
                "review_creation_date,review_answer_timestamp\n")
        f.write('r1,o1,5,"Ok","line one\nline ""two""",2020-01-01 00:00:00,NA\n')
    rows = null_tokens_to_null(read_csv_table(spark, path, SCHEMAS["reviews"])).collect()
    assert len(rows) == 1
    assert rows[0].review_comment_message == 'line one\nline "two"'
    assert rows[0].review_answer_timestamp is None


def test_content_text_rounds_half_even(spark):
    df = spark.createDataFrame([("toys", 40.0, 4.25), (None, 300.0, 3.0), ("bed", 100.0, 4.35)],
                               "category string, price double, score double")
    got = [r[0] for r in df.select(C.content_text(
        F.col("category"), C.price_bucket(F.col("price")), F.col("score"))).collect()]
    assert got == ["toys Low 4.2", " High 3.0", "bed Mid 4.4"]


def test_requests_outside_api_bounds_are_rejected(spark):
    req = spark.createDataFrame([("a", "SP", 0), ("b", "SP", 1), ("c", "SP", 50), ("d", "SP", 51)],
                                "user_id string, state string, n int")
    assert sorted(r.user_id for r in router.valid_requests(req).collect()) == ["b", "c"]


def test_segments_mark_known_users_warm(spark):
    req = spark.createDataFrame([("u1", "SP", 5), ("u2", None, 5)],
                                "user_id string, state string, n int")
    known = spark.createDataFrame([("u1", "p1"), ("u1", "p2")], "user_id string, product_id string")
    got = {r.user_id: r.segment for r in router.segments(req, known).collect()}
    assert got == {"u1": "warm", "u2": "cold"}


def test_rows_without_a_user_belong_to_no_group(spark):
    m = master(spark, [dict(user_id=None, order_id="o1"), dict(user_id="u1", order_id="o2")])
    for df in (profiles.user_profiles(m), profiles.time_features(m), profiles.interaction_counts(m),
               feat.pair_facts(feat.pair_state_facts(m)), feat.purchase_history(m)):
        assert [r.user_id for r in df.collect()] == ["u1"]


def test_payment_sums_are_exact(spark):
    rows = [("o", 0.1)] * 10 + [("p", 1e9), ("p", 0.000000001), ("p", -1e9)]
    got = {r.order_id: r.payment_value for r in clean.payment_per_order(
        spark.createDataFrame(rows, "order_id string, payment_value double")).collect()}
    assert got == {"o": 1.0, "p": 0.000000001}


def test_exact_sums_round_once(spark):
    # a sum cost two decimals of every row, one to round and one to add; the cast rounds too
    values = [0.0000000005, -0.0000000005, 2.5e-9, 0.1, 1234567.123456789, -9.9999999996, 98765432.12345679, 1e15, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    for total in (C.exact_sum(F.col("v")), C.exact_avg(F.col("v"))):
        assert "round(" not in df.agg(total.alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (str(r.s), r.a) for r in df.groupBy("k").agg(C.exact_sum(F.col("v")).cast("string").alias("s"),
                                                             C.exact_avg(F.col("v")).alias("a")).collect()}
    for k, v in enumerate(values[:-1]):
        want = Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
        assert Decimal(got[k][0]) == want and got[k][1] == float(want)
    assert got[len(values) - 1] == ("None", None)


def test_scores_of_shared_sums_are_those_of_the_master(spark):
    m = master(spark, [dict(order_id="o1"), dict(order_id="o2", customer_state="RJ", review_score=5.0),
                       dict(order_id="o3", customer_state=None, payment_value=90.0),
                       dict(order_id="o4", user_id="u2", customer_state=None, product_id="p2"),
                       dict(order_id="o5", user_id=None), dict(order_id="o6", user_id="u2", payment_value=None)])
    pair_state = feat.pair_state_facts(m)
    model = pop.fit(m, pair_state=pair_state)
    g, s = pop.scores_from_master(m)
    assert sorted(model.global_scores.collect()) == sorted(g.collect())
    assert sorted(model.state_scores.collect()) == sorted(s.collect())
    assert (model.global_scores.schema, model.state_scores.columns) == (g.schema, s.columns)
    assert {r.product_id: r.score for r in g.collect()} == {"p1": 8 + 10 + 9 + 5, "p2": 5}
    assert {(r.state, r.product_id): r.score for r in s.collect()} == {("SP", "p1"): 8 + 5, ("RJ", "p1"): 10}
    assert sorted(feat.pair_history(feat.pair_facts(pair_state)).collect()) == sorted(feat.purchase_history(m).collect())


def test_scratch_tables_expire(spark):
    import os

    from basketry import session
    folder = session.checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    session.cut_lineage(spark.range(3))
    old = set(os.listdir(folder)) - before
    new = session.cut_lineage(spark.range(4))
    os.makedirs(f"{folder}/my-own-folder")
    for n in (*old, "my-own-folder"):
        os.utime(f"{folder}/{n}", (0, 0))
    assert session.expire_scratch(spark, 10_000) == 1
    assert not old & set(os.listdir(folder)) and "my-own-folder" in os.listdir(folder)
    assert new.count() == 4
