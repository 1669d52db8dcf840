"""The test-table binding reproduces the hand counts of FIXTURES.md §3 (sf0.001)."""

from pyspark.sql import functions as F

from emporia.operators import market, sales
from emporia.sources.roles import bind_testdata, in_year
from tests.conftest import SF0001


def test_role_counts(spark):
    t = bind_testdata(spark, SF0001)
    t.validate()
    assert t.order.count() == 1500
    assert t.item.count() == 6000
    assert t.product.count() == 200
    assert t.customer.count() == 150
    assert t.seller.count() == 10
    assert t.payment.count() == 1575
    assert t.payment.filter(F.col("payment_type") == "VOUCHER").count() == 75


def test_review_scores(spark):
    t = bind_testdata(spark, SF0001)
    dist = {r["score"]: r["count"] for r in t.review.groupBy("score").count().collect()}
    assert dist == {1: 120, 2: 355, 3: 311, 4: 310, 5: 377}


def test_lateness_split(spark):
    t = bind_testdata(spark, SF0001)
    late = F.to_date("delivered_ts") > F.to_date("promised_ts")
    row = t.order.agg(F.count_if(late == F.lit(False)).alias("ontime"), F.count_if(late).alias("late"),
                      F.count_if(late.isNull()).alias("unknown")).first()
    assert (row["ontime"], row["late"], row["unknown"]) == (380, 104, 1016)


def test_hot_slow_counts(spark):
    t = bind_testdata(spark, SF0001)
    classes = {r["class"]: r["count"] for r in sales.hot_slow_products(t).groupBy("class").count().collect()}
    assert classes == {"slow": 50, "mid": 100, "hot": 50}
    r = sales.hot_slow_bad_review_rate(t).first()
    assert (r["bad_slow"], r["n_slow"]) == (359, 1213)
    assert (r["bad_hot"], r["n_hot"]) == (511, 1776)


def test_market_counts(spark):
    t = bind_testdata(spark, SF0001)
    assert market.low_penetration_high_potential(t).count() == 5
    r = market.cross_state_order_share(t).first()
    assert (r["cross_orders"], r["orders"]) == (1434, 1473)
    assert market.cross_state_freight(t).first()["t"] == 0.223606


def test_repeat_and_completion_counts(spark):
    from emporia.operators import customers, feedback

    t = bind_testdata(spark, SF0001)
    r = customers.repeat_vs_single_score(t.restrict_orders(in_year(1999))).first()
    assert (r["n_single"], r["n_repeat"]) == (51, 70)
    p1 = {r["payment_type"]: (r["completed"], r["orders"])
          for r in feedback.completion_rate_by_payment(t).collect()}
    assert p1["1-URGENT"] == (92, 273)


def test_restricted_orders_restrict_every_fact(spark):
    from tests.conftest import SF001

    t = bind_testdata(spark, SF001).restrict_orders(in_year(1999))
    ids = {r.order_id for r in t.order.select("order_id").collect()}
    for role in ("item", "payment", "review"):
        assert {r.order_id for r in getattr(t, role).select("order_id").distinct().collect()} <= ids
    r = market.cross_state_order_share(t).first()
    assert r.orders == t.item.select("order_id").distinct().count() == 2262


def test_unknown_states_are_in_neither_group(spark):
    from dataclasses import replace

    t = bind_testdata(spark, SF0001)
    t = replace(t, seller=t.seller.withColumn("state", F.lit(None).cast("string")))
    r = market.cross_state_freight(t).first()
    assert (r.n_cross, r.n_same, r.n_unknown, r.t) == (0, 0, 6000, None)
    r = market.cross_state_order_share(t).first()
    assert (r.orders, r.unknown_orders, r.share) == (0, 1473, None)


def test_null_payment_method_is_unknown(spark):
    from dataclasses import replace

    from emporia.operators import feedback
    from emporia.plans.sql import SPARK_SQL, run_sql

    t = bind_testdata(spark, SF0001)
    kind = F.when(F.col("payment_type") != "1-URGENT", F.col("payment_type"))
    u = replace(t, payment=t.payment.withColumn("payment_type", kind))
    got = {r.payment_type: (r.completed, r.orders) for r in feedback.completion_rate_by_payment(u).collect()}
    assert got["unknown"] == (92, 273) and "1-URGENT" not in got
    via_sql = run_sql(spark, u, SPARK_SQL["completion_rate_by_payment"]).collect()
    assert {r.payment_type: (r.completed, r.orders) for r in via_sql} == got
    assert {r.payment_type: r.orders for r in feedback.avg_order_amount_by_payment(u).collect()}["unknown"] == 273


def test_chi2_of_a_degenerate_table_is_null(spark):
    from dataclasses import replace

    from emporia.operators import feedback

    t = bind_testdata(spark, SF0001)
    u = replace(t, order=t.order.withColumn("status", F.lit("delivered")))
    assert tuple(feedback.completion_payment_chi2(u).first()) == (None, None, None)
