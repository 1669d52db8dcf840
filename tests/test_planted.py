
import datetime as dt
import math
import statistics

import pytest

from emporia.operators import customers, feedback, logistics, market, sales
from emporia.plans.bases import order_review
from tests.conftest import money, product_row, ts


def order(oid, cid, day, status="delivered", delivered=None, promised=None):
    return (oid, cid, status, ts(day), delivered and ts(delivered), promised and ts(promised))


def cust(cid, person, city="X", state="S", geo="g1"):
    return (cid, person, city, state, geo)


def test_person_key_drives_repeat_analyses(make_roles):
    t = make_roles(
        customer=[cust("c1", "P"), cust("c2", "P"), cust("c3", "Q")],
        order=[order("o1", "c1", "2020-01-01"), order("o2", "c2", "2020-01-11"),
               order("o3", "c3", "2020-01-05")],
    )
    r = customers.repeat_rate(t).first()
    assert (r.customers, r.repeat_customers, r.repeat_rate) == (2, 1, 0.5)
    gaps = {r.bucket: r.gaps for r in customers.repurchase_gaps(t).collect()}
    assert gaps["8-30"] == 1 and sum(gaps.values()) == 1 and len(gaps) == 7
    s = customers.repurchase_gap_summary(t).first()
    assert (s.gaps, s.avg_days, s.p50, s.p90) == (1, 10.0, 10.0, 10.0)


def test_same_day_repeats_count_as_zero_gaps(make_roles):
    t = make_roles(
        customer=[cust("c1", "P")],
        order=[order("o1", "c1", "2020-01-01"), order("o2", "c1", "2020-01-01"),
               order("o3", "c1", "2020-01-01"), order("o4", "c1", "2020-01-06")],
    )
    gaps = {r.bucket: r.gaps for r in customers.repurchase_gaps(t).collect()}
    assert gaps["0"] == 2 and gaps["1-7"] == 1
    s = customers.repurchase_gap_summary(t).first()
    assert (s.gaps, s.avg_days, s.p50) == (3, round(5 / 3, 6), 0.0)


def test_no_fan_out_across_items_payments_reviews(make_roles):
    t = make_roles(
        customer=[cust("c1", "P")],
        order=[order("o1", "c1", "2020-01-01")],
        item=[("o1", "p1", "s1", 1, money(10), money(1)), ("o1", "p2", "s1", 1, money(20), money(2))],
        product=[product_row("p1", "A"), product_row("p2", "B")],
        payment=[("o1", 1, "card", 1, money(50)), ("o1", 2, "voucher", 1, money(30))],
        review=[("o1", 1, ts("2020-01-05")), ("o1", 5, ts("2020-01-09"))],
        seller=[("s1", "X", "S", "g1")],
    )
    c1 = customers.top_customers(t).first()
    assert (c1.order_amount, c1.orders, c1.rank) == (80.0, 1, 1)
    s3 = {r.category: (r.sales, r.share) for r in sales.top_categories_share(t).collect()}
    assert s3 == {"B": (20.0, 0.666667), "A": (10.0, 0.333333)}
    p2 = {r.payment_type: (r.orders, r.avg_order_amount)
          for r in feedback.avg_order_amount_by_payment(t).collect()}
    assert p2 == {"card": (1, 80.0), "voucher": (1, 80.0)}
    c5 = {r.payment_type: (r.orders, r.payment_value, r.aov)
          for r in customers.top_customer_payment_aov(t).collect()}
    assert c5 == {"card": (1, 50.0, 50.0), "voucher": (1, 30.0, 30.0), None: (1, 80.0, 80.0)}
    assert order_review(t).first().score == 5  # latest review wins
    rows = [("a", 5, None), ("a", 1, ts("0001-01-01")), ("b", 2, ts("9999-12-31T23:59:59.999999")), ("b", 5, ts("9999-12-31T23:59:59.999998")),
            ("c", None, ts("2020-01-01")), ("c", 3, ts("2020-01-01")), ("d", None, None), ("e", -15, None), ("f", 15, ts("1950-03-04T05:06:07.000008")),
            ("f", 1, ts("1950-03-04T05:06:07.000007"))]
    assert {r.order_id: r.score for r in order_review(make_roles(review=rows)).collect()} == {"a": 1, "b": 2, "c": 3, "d": None, "e": -15, "f": 15}
    with pytest.raises(Exception, match="outside"):
        order_review(make_roles(review=[("a", 16, None)])).collect()
    m1 = market.city_penetration(t).first()
    assert (m1.orders, m1.sales, m1.customers) == (1, 30.0, 1)


def test_null_delivery_category_and_geo(make_roles):
    t = make_roles(
        customer=[cust("c1", "P", geo="g1")],
        order=[order("o1", "c1", "2020-01-01", delivered="2020-01-10", promised="2020-01-05"),
               order("o2", "c1", "2020-01-02", status="shipped", promised="2020-01-20")],
        item=[("o1", "p1", "s1", 1, money(10), money(5)), ("o2", "pX", "s2", 1, money(7), money(1))],
        product=[product_row("p1", None)],
        seller=[("s1", "X", "S", "g1"), ("s2", "Y", "T", "g-missing")],
        geo=[("g1", -10.0, -50.0)],
        review=[("o1", 2, None), ("o2", 5, None)],
    )
    cats = [(r.category, r.units) for r in customers.top_customer_categories(t).collect()]
    assert cats == [("unknown", 2)]
    dist = {r.order_id: r.distance_km for r in logistics.top_freight_orders(t).collect()}
    assert dist == {"o1": 0.0, "o2": None}
    l3 = logistics.late_vs_ontime_score(t).first()
    assert (l3.n_late, l3.n_ontime, l3.t) == (1, 0, None)
    l4 = logistics.late_orders_by_city(t).first()
    assert (l4.late_orders, l4.delivered_orders, l4.late_rate, l4.late_share) == (1, 1, 1.0, 1.0)
    m3 = market.cross_state_order_share(t).first()
    assert (m3.orders, m3.cross_orders) == (2, 1)  # o2's seller is in state T


def test_same_city_name_in_two_states(make_roles):
    t = make_roles(
        customer=[cust("c1", "P", city="X", state="S1"), cust("c2", "Q", city="X", state="S2")],
        order=[order("o1", "c1", "2020-01-01", delivered="2020-01-02", promised="2020-01-05"),
               order("o2", "c2", "2020-01-01", delivered="2020-01-09", promised="2020-01-05")],
    )
    m1 = sorted((r.state, r.city, r.orders) for r in market.city_penetration(t).collect())
    assert m1 == [("S1", "X", 1), ("S2", "X", 1)]
    l4 = sorted((r.state, r.late_orders, r.delivered_orders) for r in logistics.late_orders_by_city(t).collect())
    assert l4 == [("S1", 0, 1), ("S2", 1, 1)]


def test_tie_at_kth_place_returns_exactly_k(make_roles):
    t = make_roles(
        customer=[cust(f"c{i}", f"P{i}") for i in range(3)],
        order=[order(f"o{i}", f"c{i}", "2020-01-01") for i in range(3)],
        payment=[(f"o{i}", 1, "card", 1, money(100)) for i in range(3)],
    )
    rows = customers.top_customers(t, k=2).orderBy("rank").collect()
    assert [(r.person_id, r.rank) for r in rows] == [("P0", 1), ("P1", 2)]


def test_missing_month_and_zero_base(make_roles):
    t = make_roles(
        customer=[cust("c1", "P1"), cust("c2", "P2")],
        order=[order("o1", "c1", "2020-01-15"), order("o2", "c2", "2020-03-10")],
        item=[("o1", "p1", "s1", 1, money(10), money(1)), ("o2", "p1", "s1", 1, money(5), money(1))],
    )
    c6 = [(r.month, r.new_users, r.cumulative_users)
          for r in customers.user_growth(t).orderBy("month").collect()]
    assert c6 == [(dt.date(2020, 1, 1), 1, 1), (dt.date(2020, 2, 1), 0, 1), (dt.date(2020, 3, 1), 1, 2)]
    s1 = [(r.sales, r.prev_sales, r.growth, r.complete)
          for r in sales.sales_growth(t).orderBy("month").collect()]
    assert s1 == [(10.0, None, None, False), (0.0, 10.0, -1.0, True), (5.0, 0.0, None, False)]


def _welch(a, b):
    va, vb = statistics.variance(a), statistics.variance(b)
    se = math.sqrt(va / len(a) + vb / len(b))
    t = (statistics.mean(a) - statistics.mean(b)) / se
    df = (va / len(a) + vb / len(b)) ** 2 / ((va / len(a)) ** 2 / (len(a) - 1) + (vb / len(b)) ** 2 / (len(b) - 1))
    return t, df


def test_planted_effect_repeat_buyers_score_higher(make_roles):
    cust_rows, orders, reviews = [], [], []
    rep_means, single_means = [], []
    for i in range(40):
        cust_rows.append(cust(f"r{i}", f"R{i}"))
        a, b = (5, 4) if i % 2 else (5, 5)
        for j, s in enumerate((a, b)):
            orders.append(order(f"r{i}-{j}", f"r{i}", f"2020-0{j + 1}-01"))
            reviews.append((f"r{i}-{j}", s, None))
        rep_means.append((a + b) / 2)
        cust_rows.append(cust(f"s{i}", f"S{i}"))
        orders.append(order(f"s{i}", f"s{i}", "2020-01-01"))
        s = 3 + i % 3
        reviews.append((f"s{i}", s, None))
        single_means.append(s)
    t = make_roles(customer=cust_rows, order=orders, review=reviews)
    r = customers.repeat_vs_single_score(t).first()
    exp_t, exp_df = _welch(rep_means, single_means)
    assert (r.n_repeat, r.n_single) == (40, 40)
    assert r.t == pytest.approx(exp_t, abs=1e-5) and r.t > 0
    assert r.df == pytest.approx(exp_df, abs=1e-5)
    assert r.p_one_sided == pytest.approx(max(0.5 * math.erfc(exp_t / math.sqrt(2)), 1e-6), abs=2e-6)


def test_planted_effect_late_orders_score_lower(make_roles):
    orders, reviews = [], []
    late_scores, ontime_scores = [], []
    for i in range(40):
        orders.append(order(f"l{i}", "c1", "2020-01-01", delivered="2020-01-20", promised="2020-01-10"))
        s = 2 + i % 3
        reviews.append((f"l{i}", s, None))
        late_scores.append(s)
        orders.append(order(f"e{i}", "c1", "2020-01-01", delivered="2020-01-05", promised="2020-01-10"))
        s = 3 + i % 3
        reviews.append((f"e{i}", s, None))
        ontime_scores.append(s)
    t = make_roles(customer=[cust("c1", "P")], order=orders, review=reviews)
    r = logistics.late_vs_ontime_score(t).first()
    exp_t, _ = _welch(late_scores, ontime_scores)
    assert r.t == pytest.approx(exp_t, abs=1e-5) and r.t < 0
    assert r.p_one_sided == pytest.approx(max(0.5 * math.erfc(-exp_t / math.sqrt(2)), 1e-6), abs=2e-6)


def test_planted_effect_cross_state_freight_higher(make_roles):
    items, cross_f, same_f = [], [], []
    for i in range(40):
        f = 20 + i % 5
        items.append(("o1", "p1", "far", 1, money(100), money(f)))
        cross_f.append(f)
        g = 18 + i % 4
        items.append(("o1", "p1", "near", 1, money(100), money(g)))
        same_f.append(g)
    t = make_roles(
        customer=[cust("c1", "P", state="S")], order=[order("o1", "c1", "2020-01-01")], item=items,
        product=[product_row("p1", "A", weight=500.0)],
        seller=[("far", "Y", "T", "g2"), ("near", "X", "S", "g1")],
    )
    r = market.cross_state_freight(t).first()
    exp_t, _ = _welch(cross_f, same_f)
    assert (r.n_cross, r.n_same) == (40, 40)
    assert r.t == pytest.approx(exp_t, abs=1e-5) and r.t > 0
    assert r.per_kg_cross == pytest.approx(sum(cross_f) / (40 * 0.5), abs=1e-6)


def test_planted_effect_slow_products_reviewed_worse(make_roles):
    items, orders, reviews = [], [], []
    n = 0
    for pid, units, bad_every in (("pA", 1, 4), ("pB", 1, 4), ("pC", 10, 4), ("pD", 10, 4)):
        for j in range(20):
            oid = f"o{n}"
            n += 1
            orders.append(order(oid, "c1", "2020-01-01"))
            items.append((oid, pid, "s1", units, money(10), money(1)))
            slow = units == 1
            bad = (j % 4 != 0) if slow else (j % 4 == 0)
            reviews.append((oid, 1 if bad else 5, None))
    t = make_roles(customer=[cust("c1", "P")], order=orders, item=items, review=reviews,
                   product=[product_row(p) for p in ("pA", "pB", "pC", "pD")])
    classes = {r.product_id: r["class"] for r in sales.hot_slow_products(t).collect()}
    assert classes == {"pA": "slow", "pB": "slow", "pC": "hot", "pD": "hot"}
    r = sales.hot_slow_bad_review_rate(t).first()
    assert (r.n_slow, r.bad_slow, r.n_hot, r.bad_hot) == (40, 30, 40, 10)
    assert r.z == pytest.approx(0.5 / math.sqrt(0.25 * (2 / 40)), abs=1e-5)


def test_one_unit_in_a_group_gives_null_statistic(make_roles):
    t = make_roles(
        customer=[cust("c1", "P"), cust("c2", "Q")],
        order=[order("o1", "c1", "2020-01-01"), order("o2", "c1", "2020-02-01"), order("o3", "c2", "2020-01-01")],
        review=[("o1", 5, None), ("o2", 4, None), ("o3", 1, None)],
    )
    r = customers.repeat_vs_single_score(t).first()
    assert (r.n_repeat, r.n_single, r.t, r.df, r.p_one_sided) == (1, 1, None, None, None)


def test_seller_concentration_and_summary(make_roles):
    # seller a: 3 bad of 4; b: 1 bad of 2; c: 0 of 2 -> shares 0.75, 0.25, 0
    specs = {"a": [1, 1, 2, 5], "b": [1, 5], "c": [4, 5]}
    items, reviews, n = [], [], 0
    for sid, scores in specs.items():
        for s in scores:
            items.append((f"o{n}", "p1", sid, 1, money(1), money(1)))
            reviews.append((f"o{n}", s, None))
            n += 1
    t = make_roles(item=items, review=reviews)
    rows = {r.seller_id: r for r in feedback.seller_bad_review_concentration(t).collect()}
    assert [rows[s].rank for s in "abc"] == [1, 2, 3]
    assert [rows[s].cum_share for s in "abc"] == [0.75, 1.0, 1.0]
    s = feedback.seller_bad_review_summary(t).first()
    assert (s.sellers, s.bad, s.top_sellers, s.top_share) == (3, 4, 1, 0.75)
    assert s.hhi == round(0.75 ** 2 + 0.25 ** 2, 6)


def test_installment_rollup(make_roles):
    t = make_roles(payment=[("o1", 1, "card", 2, money(100)), ("o2", 1, "card", 4, money(80)),
                            ("o3", 1, "card", 1, money(999))])
    rows = {r.installments: (r.payments, r.avg_value, r.avg_installment)
            for r in feedback.installment_avg_payment(t).collect()}
    assert rows == {2: (1, 100.0, 50.0), 4: (1, 80.0, 20.0), None: (2, 90.0, 35.0)}
