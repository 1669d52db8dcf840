"""The incremental order mart and the monthly sketches."""

import math
import random

import pytest

from emporia.operators import customers, market, sketches
from emporia.plans.catalog import ANALYSES
from emporia.sources.order_mart import NO_MONTH, ORDER_GRAIN, OrderMart, order_mart, touched
from pyspark.sql import functions as F
from tests.conftest import money, ts


def history(make_roles, months, seed=1, late_review=False):
    rng = random.Random(seed)
    cust = [(f"c{i}", f"P{i % 12}", f"City{i % 3}", f"S{i % 2}", "g") for i in range(20)]
    orders, items, pays, reviews = [], [], [], []
    for m in range(months):
        for k in range(12 if m else 11):
            oid = f"o{m:02d}_{k}"
            placed = f"{2019 + m // 12}-{m % 12 + 1:02d}-{rng.randint(1, 28):02d}"
            orders.append((oid, f"c{rng.randrange(20)}", "delivered", ts(placed), ts(placed) if k % 3 else None, ts(placed)))
            items += [(oid, f"p{rng.randrange(5)}", "s", rng.randint(1, 3), money(rng.randint(1, 90)), money(1.5)) for _ in range(rng.randint(0, 2))]
            pays += [(oid, i, "card", 1, money(rng.randint(1, 50))) for i in range(rng.randint(0, 2))]
            if k % 4:
                reviews.append((oid, rng.randint(1, 5), ts(placed)))
    orders.append(("untimed", "c1", "shipped", None, None, None))
    if late_review:
        reviews += [("o02_1", 5, ts("2030-01-01"))]
    return make_roles(customer=cust, order=orders, item=items, payment=pays, review=reviews)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_refresh_rewrites_one_month_and_equals_a_full_refresh(spark, make_roles, tmp_path):
    mart = OrderMart(spark, f"file://{tmp_path}/mart")
    with pytest.raises(FileNotFoundError):
        mart.read()
    first, then = history(make_roles, 5), history(make_roles, 6)
    assert len(mart.refresh(first)) == 6 and NO_MONTH in mart.manifest()["months"]
    before = mart.manifest()
    held = rows(mart.read())
    assert touched(then, "2019-06-01") == ["2019-06-01"]
    assert mart.refresh(then, touched(then, "2019-06-01")) == ["2019-06-01"]
    after = mart.manifest()
    assert {m for m in after["months"] if after["months"][m] != before["months"].get(m)} == {"2019-06-01"} and after["version"] == 2
    full = OrderMart(spark, f"file://{tmp_path}/full")
    full.refresh(then)
    assert rows(mart.read()) == rows(full.read()) == rows(order_mart(then)) and len(rows(mart.read())) == len(held) + 12
    assert rows(mart.read(["2019-06-01"])) == rows(full.read(["2019-06-01"]))


def test_late_reviews_touch_their_month(spark, make_roles, tmp_path):
    mart = OrderMart(spark, f"file://{tmp_path}/mart")
    mart.refresh(history(make_roles, 4))
    now = history(make_roles, 4, late_review=True)
    assert touched(now, "2029-01-01") == ["2019-03-01"] and mart.refresh(now, ["2019-03-01"]) == ["2019-03-01"]
    assert rows(mart.read()) == rows(order_mart(now))
    assert mart.read().where("order_id = 'o02_1'").first().score == 5
    gone = mart.vacuum()
    assert any(g.endswith("month=2019-03-01") for g in gone) and any(g.startswith("manifest-") for g in gone)
    assert rows(mart.read()) == rows(order_mart(now)) and mart.vacuum() == []


def test_a_failed_refresh_publishes_nothing(spark, make_roles, tmp_path, monkeypatch):
    mart = OrderMart(spark, f"file://{tmp_path}/mart")
    t = history(make_roles, 3)
    mart.refresh(t)
    held = rows(mart.read())
    monkeypatch.setattr(OrderMart, "_publish", lambda self, state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        mart.refresh(history(make_roles, 3, seed=2))
    monkeypatch.undo()
    assert rows(mart.read()) == held and mart.manifest()["version"] == 1
    # Two refreshes of one version: the second must not replace the first.
    with pytest.raises(RuntimeError, match="published already"):
        mart._publish({"version": 1, "months": {}})
    assert rows(mart.read()) == held
    # A month that lost its orders leaves the mart; no months: nothing changes.
    assert mart.refresh(t.restrict_orders(F.col("purchase_ts") < F.lit("2019-03-01").cast("timestamp_ntz")), ["2019-03-01"]) == []
    assert "2019-03-01" not in mart.manifest()["months"] and mart.refresh(t, []) == []


def test_analyses_from_the_mart_equal_those_from_the_roles(spark, make_roles, tmp_path):
    t = history(make_roles, 15, late_review=True)
    mart = OrderMart(spark, f"file://{tmp_path}/mart")
    mart.refresh(t)
    base = mart.roles(t)
    for name in ORDER_GRAIN:
        assert rows(ANALYSES[name].run(base)) == rows(ANALYSES[name].run(t)), name
    paths = mart.write_dependent(t, f"file://{tmp_path}/out", ("sales_growth", "city_penetration"))
    assert rows(spark.read.parquet(paths["city_penetration"])) == rows(market.city_penetration(t))


def test_sketches_merge_to_the_whole(spark, make_roles):
    rng = random.Random(4)
    n = 6000
    cust = [(f"c{i}", f"P{i % 4000}", f"C{i % 2}", "S", "g") for i in range(n)]
    orders = [(f"o{i}", f"c{rng.randrange(n)}", "delivered", ts(f"2020-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"), None, None) for i in range(n)]
    pays = [(f"o{i}", 1, "card", 1, money(rng.randint(1, 1000))) for i in range(n)]
    t = make_roles(customer=cust, order=orders, payment=pays)
    months = sketches.monthly_sketches(t)
    whole = sketches.merged(months).select("orders", "buyers", F.kll_sketch_get_quantile_bigint("amounts", F.lit(0.5)).alias("median")).first()
    buyers = len({cust[int(o[1][1:])][1] for o in orders})
    values = sorted(float(p[4]) * 100 for p in pays)
    assert whole.orders == n and abs(whole.buyers - buyers) <= sketches.HLL_BOUND * buyers
    assert abs(sum(v <= whole.median for v in values) / n - 0.5) <= sketches.KLL_BOUND
    per_city = {r.city: r for r in sketches.city_buyers_sketched(t).collect()}
    assert all(r.within_bound for r in per_city.values()) and {c: r.customers for c, r in per_city.items()} == {
        r.city: r.customers for r in market.city_penetration(t).collect()}
    gaps = sketches.repurchase_gaps_sketched(t).collect()
    assert len(gaps) == len(sketches.PERCENTILES) and all(r.within_bound for r in gaps)
    p50 = customers.repurchase_gap_summary(t).first().p50
    assert math.isclose(next(r.exact for r in gaps if r.p == 0.5), p50, abs_tol=1)
    assert sketches.repurchase_gaps_sketched(make_roles()).count() == 0 and sketches.city_buyers_sketched(make_roles()).count() == 0
