
import pytest
from pyspark.sql import functions as F

from emporia.operators import customers, feedback, logistics, market, sales
from emporia.plans.bases import order_pay
from emporia.sources.roles import bind_testdata
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def t(spark):
    return bind_testdata(spark, SF0001)


def _sum(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_shares_sum_to_one(t):
    assert _sum(customers.top_customer_geo(t), "customer_share") == pytest.approx(1.0, abs=1e-4)
    assert _sum(customers.repurchase_gaps(t), "share") == pytest.approx(1.0, abs=1e-4)
    assert _sum(logistics.late_orders_by_city(t), "late_share") == pytest.approx(1.0, abs=1e-4)
    assert _sum(feedback.seller_bad_review_concentration(t), "bad_share") == pytest.approx(1.0, abs=1e-4)
    top = sales.top_categories_share(t, n=1000)
    assert _sum(top, "share") == pytest.approx(1.0, abs=1e-4)


def test_cumulative_users_equal_customers(t):
    last = customers.user_growth(t).orderBy(F.col("month").desc()).first().cumulative_users
    assert last == customers.repeat_rate(t).first().customers


def test_city_totals_equal_global_totals(t):
    m1 = market.city_penetration(t).agg(F.sum("orders").alias("o"), F.sum("sales").alias("s")).first()
    assert m1.o == t.order.count()
    assert m1.s == pytest.approx(float(_sum(t.item, "price")), abs=1e-6)


def test_order_amounts_unchanged_by_joining_payments(t):
    direct = float(_sum(t.payment, "value"))
    via_orders = float(_sum(t.order.join(order_pay(t), "order_id"), "order_amount"))
    assert via_orders == pytest.approx(direct, abs=1e-6)
    top_all = customers.top_customers(t, k=10_000)
    assert _sum(top_all, "order_amount") == pytest.approx(direct, abs=1e-4)


def test_top_customer_units_bounded_by_all_units(t):
    assert _sum(customers.top_customer_categories(t), "units") <= _sum(t.item, "units")
    assert _sum(customers.top_customer_categories(t, k=10_000), "units") == _sum(t.item, "units")


def test_sales_growth_covers_every_month(t):
    s1 = sales.sales_growth(t)
    assert s1.count() == 80  # 1995-01 .. 2001-08 without gaps
    assert s1.filter(~F.col("complete")).count() == 1  # only the one-day last month
    assert _sum(s1, "sales") == pytest.approx(float(_sum(t.item, "price")), abs=1e-4)
