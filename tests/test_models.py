"""ALS invariants, store round trip, the missing-input guard, streaming serving."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from basketry.functions.text import ENGLISH_STOP_WORDS
from basketry.operators import als, clean, router
from basketry.operators import features as feat
from basketry.operators import popularity as pop
from basketry.operators import profiles
from basketry.plans import train as train_plan
from basketry.plans.queries import master_of
from basketry.sources import store
from basketry.sources.fixtures import (DELIVERED_STATUS, PRICE_BUCKET_THRESHOLDS,
                                       customer_requests, driver_tables)
from basketry.sources.tables import MissingInputError, load_raw
from tests.conftest import SF_SMALL

SMALL_ALS = dict(factors=8, iterations=3)


@pytest.fixture(scope="module")
def fitted(spark):
    master = master_of(spark, SF_SMALL)
    inter = feat.interactions(master)
    rec = als.fit(inter, **SMALL_ALS)
    return master, inter, rec


def test_als_invariants(spark, fitted):
    master, inter, rec = fitted
    history = feat.purchase_history(master)
    req = customer_requests(spark, SF_SMALL, n=7)
    recs = als.recommend(rec, req, history, over_fetch=1).cache()
    # no purchased product
    assert recs.join(history, ["user_id", "product_id"], "left_semi").count() == 0
    per_user = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"),
                                           F.max("rank").alias("m"),
                                           F.countDistinct("rank").alias("d")).collect()
    assert per_user and all(r.c <= 7 and r.m == r.c and r.d == r.c for r in per_user)
    # warm users only: every recommended user has an interaction
    assert recs.join(inter, "user_id", "left_anti").count() == 0


def test_als_is_deterministic(spark, fitted):
    master, inter, _ = fitted
    history = feat.purchase_history(master)
    req = customer_requests(spark, SF_SMALL, n=5)
    a = als.recommend(als.fit(inter, **SMALL_ALS), req, history).select("user_id", "product_id")
    b = als.recommend(als.fit(inter, **SMALL_ALS), req, history).select("user_id", "product_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_router_warm_and_cold(spark, fitted):
    master, _, rec = fitted
    out = router.recommend_for_users(
        customer_requests(spark, SF_SMALL), pop.fit(master), rec,
        feat.purchase_history(master), profiles.product_profiles(master))
    seg = {r.segment: r.c for r in out.groupBy("segment").agg(F.countDistinct("user_id")
                                                              .alias("c")).collect()}
    assert seg["warm"] == rec.users.count()
    assert seg["cold"] == driver_tables(spark, SF_SMALL).customers.count() - seg["warm"]
    assert out.where(F.col("rank") > 10).count() == 0


def test_store_round_trip_and_missing_history(spark, tmp_dir):
    models = train_plan.fit_models(driver_tables(spark, SF_SMALL), delivered=DELIVERED_STATUS,
                                   price_thresholds=PRICE_BUCKET_THRESHOLDS,
                                   als_params=SMALL_ALS)
    models.history = None
    store.save(models, tmp_dir)
    back = store.load(spark, tmp_dir)
    assert back.history.count() == 0
    assert back.als is not None
    assert back.product_profiles.count() == models.product_profiles.count()


def test_missing_input_guard(spark, tmp_dir):
    for fmt in ("csv", "parquet"):
        for folder in (os.path.join(tmp_dir, "nothing-here"), f"file://{tmp_dir}"):
            with pytest.raises(MissingInputError, match=f"orders_dataset.{fmt}"):
                load_raw(spark, folder, fmt=fmt)


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_request_stream_matches_batch(spark, tmp_dir):
    from basketry.streaming.serve import REQUEST_SCHEMA, serve_recommendations
    models = train_plan.fit_models(driver_tables(spark, SF_SMALL), delivered=DELIVERED_STATUS,
                                   price_thresholds=PRICE_BUCKET_THRESHOLDS, with_als=False)
    req = customer_requests(spark, SF_SMALL).select(
        F.col("user_id").cast("string").alias("user_id"), "state", F.col("n").cast("int"))
    cold = req.join(models.history.select(F.col("user_id").cast("string")).distinct(),
                    "user_id", "left_anti")
    cold.write.parquet(f"{tmp_dir}/requests")
    stream = spark.readStream.schema(REQUEST_SCHEMA).parquet(f"{tmp_dir}/requests")
    q = serve_recommendations(stream, models, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_dir}/out").select("user_id", "rank", "product_id")
    batch = router.recommend_for_users(cold, models.popularity, None, models.history,
                                       models.product_profiles)
    want = batch.select(F.col("user_id").cast("string"), "rank", "product_id")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_request_stream_answers_every_request(spark, tmp_dir):
    from basketry.streaming.serve import serve_recommendations
    models = train_plan.fit_models(driver_tables(spark, SF_SMALL), delivered=DELIVERED_STATUS,
                                   price_thresholds=PRICE_BUCKET_THRESHOLDS, with_als=False)
    schema = "request_id long, user_id string, state string, n int"
    spark.createDataFrame([(1, "-1", "CHINA", None), (2, "-1", "CHINA", 0), (3, "-1", None, 50)], schema
                          ).write.parquet(f"{tmp_dir}/requests")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_dir}/requests")
    q = serve_recommendations(stream, models, f"{tmp_dir}/out", f"{tmp_dir}/ckpt", envelopes=True)
    q.awaitTermination(300)
    got = {r.request_id: (r.status, r.results_count) for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == {1: ("success", 10), 2: ("rejected", 0), 3: ("success", 50)}


def test_metrics_match_ranking_evaluator(spark):
    from pyspark.ml.evaluation import RankingEvaluator
    from basketry.operators import evaluate
    from basketry.plans.queries import eval_parts
    _, train, _, users, truth = eval_parts(spark, SF_SMALL)
    recs = evaluate.popularity_baseline(train, users)
    ours = evaluate.user_metrics(recs, truth, users).agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "average_precision", "ndcg")]
    ).collect()[0]
    pred = recs.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "product_id"))),
                    lambda s: s["product_id"].cast("double")).alias("prediction"))
    lab = truth.groupBy("user_id").agg(
        F.collect_list(F.col("product_id").cast("double")).alias("label"))
    both = lab.join(pred, "user_id", "left").select(
        F.coalesce("prediction", F.array().cast("array<double>")).alias("prediction"), "label")
    for metric, col in [("precisionAtK", "precision"), ("recallAtK", "recall"),
                        ("meanAveragePrecisionAtK", "average_precision"), ("ndcgAtK", "ndcg")]:
        ev = RankingEvaluator(metricName=metric, k=10)
        assert ev.evaluate(both) == pytest.approx(ours[col], abs=1e-12), metric


def test_similar_stream_matches_batch(spark, tmp_dir):
    from basketry.operators import content
    from basketry.streaming.serve import SIMILAR_SCHEMA, serve_similar
    models = train_plan.fit_models(driver_tables(spark, SF_SMALL), delivered=DELIVERED_STATUS,
                                   price_thresholds=PRICE_BUCKET_THRESHOLDS, with_als=False)
    req = (models.product_profiles.select(F.col("product_id").cast("string").alias("product_id"))
           .withColumn("n", F.lit(5)))
    req.write.parquet(f"{tmp_dir}/requests")
    stream = spark.readStream.schema(SIMILAR_SCHEMA).parquet(f"{tmp_dir}/requests")
    q = serve_similar(stream, models, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_dir}/out").select("query_product_id", "rank", "product_id")
    want = content.similar(models.content, req).select(
        F.col("product_id").cast("string").alias("query_product_id"), "rank",
        F.col("similar_id").alias("product_id"))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_store_without_als_loads_without_als(spark, tmp_dir):
    models = train_plan.fit_models(driver_tables(spark, SF_SMALL), delivered=DELIVERED_STATUS,
                                   price_thresholds=PRICE_BUCKET_THRESHOLDS, with_als=False)
    store.save(models, tmp_dir)
    back = store.load(spark, tmp_dir)
    assert back.als is None
    assert back.history.count() == models.history.count()
    assert back.popularity.lists.count() == models.popularity.lists.count()
    assert (back.popularity.max_n, back.content.max_n) == (models.popularity.max_n, models.content.max_n)


def _small_models(spark, with_als=False):
    return train_plan.fit_models(driver_tables(spark, SF_SMALL), delivered=DELIVERED_STATUS,
                                 price_thresholds=PRICE_BUCKET_THRESHOLDS, with_als=with_als, als_params=SMALL_ALS)


def test_the_fit_sums_the_master_once(spark, monkeypatch):
    # popularity, interactions and history each summed the master's rows again
    calls = []
    for name in ("pair_state_facts", "mean_payment", "purchase_history"):
        op = getattr(train_plan.feat, name)
        monkeypatch.setattr(train_plan.feat, name, lambda *a, _op=op, _n=name, **k: calls.append(_n) or _op(*a, **k))
    models = _small_models(spark)
    assert sorted(calls) == ["mean_payment", "pair_state_facts"]
    monkeypatch.undo()
    master = clean.build_master(driver_tables(spark, SF_SMALL), DELIVERED_STATUS)
    assert sorted(models.history.collect()) == sorted(feat.purchase_history(master).collect())
    for got, want in zip((models.popularity.global_scores, models.popularity.state_scores), pop.scores_from_master(master)):
        assert sorted(got.collect()) == sorted(want.collect())


def test_digest_sums_are_exact_without_a_decimal_a_row(spark):
    # the digest read every row's number as a decimal, which cost more than its md5
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i % 5}") for i in range(500)], "a long, b string")
    out = store.digests({"t": df, "none": df.where("a < 0")})
    numbers = [int(hashlib.md5(f"{i}|{'~' if i % 7 == 0 else f't{i % 5}'}".encode()).hexdigest()[:15], 16) for i in range(500)]
    assert {r.table_name: (r.rows, r.digest) for r in out.collect()} == {"t": (500, str(sum(numbers))), "none": (0, "0")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" in plan and "sum(cast(conv(" not in plan


def test_failed_saves_leave_the_model_before(spark, tmp_dir, monkeypatch):
    models = _small_models(spark)
    store.save(models, tmp_dir)
    before = {r.table_name: r.digest for r in store.digests(store.load(spark, tmp_dir).tables()).collect()}
    create = store._create
    # no mark at the end, and no manifest
    monkeypatch.setattr(store, "_create", lambda s, p: (_ for _ in ()).throw(OSError("lost")) if p.endswith("COMPLETE") else create(s, p))
    with pytest.raises(OSError):
        store.save(models, tmp_dir)
    monkeypatch.setattr(store, "_create", create)
    monkeypatch.setattr(store, "digests", lambda tables: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.save(models, tmp_dir)
    monkeypatch.undo()
    assert store.versions(spark, tmp_dir) == {1: True, 2: False, 3: False}
    assert {r.table_name: r.digest for r in store.digests(store.load(spark, tmp_dir).tables()).collect()} == before
    store.save(models, tmp_dir, keep=1)
    assert store.versions(spark, tmp_dir) == {2: False, 3: False, 4: True}
    assert store._create(spark, f"{tmp_dir}/x") and not store._create(spark, f"{tmp_dir}/x")


def test_a_changed_table_is_noticed(spark, tmp_dir):
    models = _small_models(spark)
    paths = store.save(models, tmp_dir)
    spark.read.parquet(paths["user_history"]).limit(3).write.mode("append").parquet(paths["user_history"])
    with pytest.raises(store.DamagedModelError, match="user_history"):
        store.load(spark, tmp_dir)
    assert store.load(spark, tmp_dir, verify=False).history.count() == models.history.count() + 3
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"{tmp_dir}/nothing")


def test_digests_ignore_order_and_see_changes(spark):
    rows = [(i, f"t{i % 3}", i / 7) for i in range(50)]
    digest = lambda r: store.digests({"t": spark.createDataFrame(r, "a long, b string, c double")}).first().digest
    assert digest(rows) == digest(rows[::-1]) != digest(rows[1:])
    assert digest(rows) != digest(rows[1:] + [(0, "t1", 0.0)]) and digest(rows + rows[:1]) != digest(rows)
    assert digest([(1, None, None)]) != digest([(None, "1", None)])


def test_als_sweeps_equal_the_normal_equations(spark):
    """MLlib's next half sweep against a plain solve: users from products, then products
    from users, of one more iteration."""
    import numpy as np
    rows = sorted({(int(a), int(b)) for a, b in np.random.default_rng(2).integers(0, 30, (300, 2))})
    inter = spark.createDataFrame([(a, b, 5 + (a * b) % 7) for a, b in rows], "user_id long, product_id long, interaction_score int")
    one, two = (als.fit(inter, factors=5, iterations=n) for n in (3, 4))
    code = lambda t: {r[0]: r[1] for r in t.collect()}
    side = lambda df: {r.id: np.array(r.features, float) for r in df.collect()}
    uc, pc = code(one.users), code(one.products)
    pairs = [(uc[a], pc[b], 5 + (a * b) % 7) for a, b in rows]

    def half(given, by_user):
        yy = sum(np.outer(y, y) for y in given.values())
        out = {}
        for me in {p[0 if by_user else 1] for p in pairs}:
            mine = [(given[p[1 if by_user else 0]], p[2]) for p in pairs if p[0 if by_user else 1] == me]
            a = yy + sum((c - 1) * np.outer(y, y) for y, c in mine) + als.REGULARIZATION * len(mine) * np.eye(5)
            out[me] = np.linalg.solve(a, sum(c * y for y, c in mine))
        return out
    users = half(side(one.model.itemFactors), True)
    for u, x in side(one.model.userFactors).items():
        assert np.allclose(users[u], x, atol=1e-3)
    items = half(side(one.model.userFactors), False)
    for p, y in side(two.model.itemFactors).items():
        assert np.allclose(items[p], y, atol=1e-3)
    worst = als.normal_residuals(one, inter).agg(F.max("residual"), F.count("*")).first()
    assert worst[0] < 1e-4 and worst[1] == len(uc)


def test_als_reaches_the_loss_of_the_reference_fit(spark):
    import numpy as np
    rows = sorted({(int(a), int(b)) for a, b in np.random.default_rng(6).integers(0, 25, (260, 2))})
    inter = spark.createDataFrame([(a, b, 5 + (a + b) % 7) for a, b in rows], "user_id long, product_id long, interaction_score int")
    users, items = als.reference_fit(inter, sweeps=15)
    x, y = ({r[0]: np.array([r.f0, r.f1]) for r in t.collect()} for t in (users, items))
    rec = als.fit(inter, factors=2, iterations=15)
    code = lambda t: {r[1]: r[0] for r in t.collect()}
    side = lambda df, c: {c[r.id]: np.array(r.features, float) for r in df.collect()}
    mx, my = side(rec.model.userFactors, code(rec.users)), side(rec.model.itemFactors, code(rec.products))

    def loss(x, y):
        n_u, n_i = ({k: sum(p[i] == k for p in rows) for k in t} for i, t in ((0, x), (1, y)))
        total = sum((x[u] @ y[i]) ** 2 for u in x for i in y)
        total += sum((5 + (u + i) % 7) * (1 - x[u] @ y[i]) ** 2 - (x[u] @ y[i]) ** 2 for u, i in rows)
        return total + als.REGULARIZATION * (sum(n_u[u] * x[u] @ x[u] for u in x) + sum(n_i[i] * y[i] @ y[i] for i in y))
    assert loss(mx, my) == pytest.approx(loss(x, y), rel=0.05)


def test_quartiles_by_narrowing_ranges(spark):
    import numpy as np
    from basketry.operators import profiling
    rng = np.random.default_rng(1)
    inf, nan = float("inf"), float("nan")
    cols = {"a": rng.lognormal(0, 3, 20_000), "b": np.where(rng.random(20_000) < 0.6, 7.0, rng.integers(0, 5, 20_000)),
            "c": np.concatenate([rng.random(19_990) * 1e-300, [1e308, -1e308, inf, -inf, -0.0, 0.0, 5, 6, 7, 8]])}
    rows = [tuple(float(cols[k][i]) if (i + j) % 13 else None for j, k in enumerate(cols)) + (None, nan if i % 2 else 1.0)
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    want = {c: sorted(r[j] for r in rows if r[j] is not None) if c != "e" else [1.0] * 10_000 + [nan] * 10_000
            for j, c in enumerate("abcde")}
    places = {c: [0, len(v) // 4, len(v) // 2, len(v) // 2 + 1, len(v) - 1] if v else [] for c, v in want.items()}
    report = []
    got = profiling.order_statistics(df, places, report)
    for c, ps in places.items():
        for p in ps:
            assert got[c, p] == want[c][p] or (got[c, p] != got[c, p] and want[c][p] != want[c][p]), (c, p)
    assert len(report) <= 8 and report[0] == 4
    d = {r.column_name: r for r in profiling.describe(df.select("a", "b", "d"), ["a", "b", "d"]).collect()}
    assert (d["a"].p25, d["a"].p50, d["b"].p75) == tuple(
        pytest.approx(float(np.quantile(want[c], q))) for c, q in (("a", 0.25), ("a", 0.5), ("b", 0.75)))
    assert d["d"]["count"] == 0 and d["d"].p50 is None


def test_duplicates_compare_whole_rows(spark, monkeypatch):
    from basketry.operators import profiling
    rows = [(1, None), (None, 1), (1, None), (None, None), (None, None), (None, None), (2, 3)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert profiling.duplicates("x", df).first().duplicates == 3
    assert profiling.duplicates("x", df, ["a"]).first().duplicates == 4
    monkeypatch.setattr(profiling, "_fingerprint", lambda cols: [F.lit(1), F.lit(2)])      # all collide
    assert profiling.duplicates("x", df).first().duplicates == 3
    assert profiling.duplicates("x", df.limit(0)).first().duplicates == 0


def test_nested_duplicates_of_rows_dealt_by_a_kept_column_are_not_shuffled_again(spark):
    from basketry.operators import profiling
    rows = [(1, "x", None), (1, "x", None), (1, "x", 2.0), (1, "y", 3.0), (2, None, 0.0), (2, None, -0.0), (2, None, None),
            (None, "x", 1.0), (None, "x", 1.0), (None, "z", 1.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition("a")
    coarse = {"a": F.col("a"), "c": F.coalesce("c", F.lit(3.0))}
    got = profiling.nested_duplicates("fine", df, "coarse", coarse)
    filled = [(a, 3.0 if c is None else c) for a, _, c in rows]
    assert {r.check_name: r.duplicates for r in got.collect()} == {
        "fine": len(rows) - len(set(rows)), "coarse": len(rows) - len(set(filled))}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert [r.duplicates for r in profiling.nested_duplicates("f", df.limit(0), "c", coarse).collect()] == [0, 0]


def test_duplicates_of_a_narrow_key_read_the_table_once(spark):
    from basketry.operators import profiling
    df = spark.createDataFrame([(1, 2), (1, 3), (None, 3), (None, 4), (None, 4)], "a long, b int")
    got = profiling.duplicates("x", df, ["a"])
    assert got.first().duplicates == 3
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_duplicates_of_the_prototype_join_need_no_written_table(spark, monkeypatch):
    from basketry.plans import queries
    written = []
    monkeypatch.setattr(queries, "cut_lineage", lambda df: written.append(df) or df)
    out = queries.q2_duplicates(spark, SF_SMALL)
    assert out.count() == 3 and not written


def test_prototype_join_columns(spark):
    from basketry.operators import clean
    t = driver_tables(spark, SF_SMALL)
    assert clean.prototype_joined(t, DELIVERED_STATUS).columns == [
        "order_id", "customer_id", "product_id", "order_status", "order_time", "order_item_id", "seller_id", "price",
        "shipping_limit_date", "product_category_name", "product_weight_g", "category", "user_id", "customer_state",
        "customer_zip_code_prefix", "review_score", "payment_value"]
