"""More planted cases: address choice, first vs repeat split, growth periods, cut-offs, chi-square."""

import datetime as dt


from emporia.operators import customers, feedback, logistics, market, sales
from tests.conftest import money, product_row, ts


def order(oid, cid, day, status="delivered"):
    return (oid, cid, status, ts(day), None, None)


def test_top_customer_geo_uses_latest_address(make_roles):
    t = make_roles(
        customer=[("c1", "P", "Old", "S1", "g"), ("c2", "P", "New", "S2", "g"), ("c3", "Q", "Old", "S1", "g")],
        order=[order("o1", "c1", "2020-01-01"), order("o2", "c2", "2020-05-01"), order("o3", "c3", "2020-02-01")],
        payment=[("o1", 1, "card", 1, money(10)), ("o2", 1, "card", 1, money(20)), ("o3", 1, "card", 1, money(5))],
    )
    rows = sorted((r.state, r.city, r.customers, r.order_amount, r.customer_share)
                  for r in customers.top_customer_geo(t).collect())
    assert rows == [("S1", "Old", 1, 5.0, 0.5), ("S2", "New", 1, 30.0, 0.5)]


def test_first_vs_repeat_categories(make_roles):
    # P: first order (A x2), later orders (B x3, A x1); Q single buyer is excluded.
    t = make_roles(
        customer=[("c1", "P", "X", "S", "g"), ("c2", "Q", "X", "S", "g")],
        order=[order("o1", "c1", "2020-01-01"), order("o2", "c1", "2020-01-01"), order("o3", "c1", "2020-03-01"),
               order("o9", "c2", "2020-01-01")],
        item=[("o1", "pA", "s", 2, money(1), money(1)), ("o2", "pB", "s", 3, money(1), money(1)),
              ("o3", "pA", "s", 1, money(1), money(1)), ("o9", "pB", "s", 50, money(1), money(1))],
        product=[product_row("pA", "A"), product_row("pB", "B")],
    )
    rows = {r.category: (r.first_units, r.repeat_units, r.first_share, r.repeat_share, r.lift, r.repeat_rank)
            for r in customers.first_vs_repeat_categories(t).collect()}
    # o1 and o2 tie on the day; o1 has the smaller id, so it is the first order.
    assert rows == {"B": (0, 3, 0.0, 0.75, None, 1), "A": (2, 1, 1.0, 0.25, 0.25, 2)}


def test_fastest_growing_uses_latest_complete_quarter(make_roles):
    # Last purchase 2021-08-15: Q3 is incomplete, so Q2 (cur) is compared with Q1 (prev).
    t = make_roles(
        order=[order("q1a", "c", "2021-02-01"), order("q2a", "c", "2021-05-01"), order("q3a", "c", "2021-08-15"),
               order("q1b", "c", "2021-03-01"), order("q2b", "c", "2021-06-30")],
        item=[("q1a", "pA", "s", 10, money(1), money(1)), ("q2a", "pA", "s", 15, money(1), money(1)),
              ("q3a", "pA", "s", 999, money(1), money(1)), ("q1b", "pB", "s", 4, money(1), money(1)),
              ("q2b", "pB", "s", 8, money(1), money(1)), ("q2b", "pC", "s", 5, money(1), money(1))],
        product=[product_row("pA", "A"), product_row("pB", "B"), product_row("pC", "C")],
    )
    rows = [(r.category, r.period, r.prev_units, r.cur_units, r.growth, r.rank)
            for r in sales.fastest_growing_categories(t).orderBy("rank").collect()]
    q2 = dt.date(2021, 4, 1)
    assert rows == [("B", q2, 4, 8, 1.0, 1), ("A", q2, 10, 15, 0.5, 2)]  # C is new: no rate
    assert sales.fastest_growing_categories(t, min_base=5).count() == 1


def test_low_penetration_high_potential_cutoffs(make_roles):
    # orders per city: 1, 2, 3, 4 (median 2.5); aov: 100, 10, 10, 10 (p75 = 32.5)
    custs, orders, pays = [], [], []
    n = 0
    for city, k, amount in (("A", 1, 100), ("B", 2, 10), ("C", 3, 10), ("D", 4, 10)):
        custs.append((f"c{city}", f"P{city}", city, "S", "g"))
        for _ in range(k):
            orders.append(order(f"o{n}", f"c{city}", "2020-01-01"))
            pays.append((f"o{n}", 1, "card", 1, money(amount)))
            n += 1
    t = make_roles(customer=custs, order=orders, payment=pays)
    rows = [(r.city, r.orders, r.aov) for r in market.low_penetration_high_potential(t).collect()]
    assert rows == [("A", 1, 100.0)]


def test_freight_profile_splits_top_k(make_roles):
    items = [(f"o{i}", "p", "s", 1, money(1), money(i + 1)) for i in range(5)]
    t = make_roles(
        customer=[("c", "P", "X", "S", "g")], order=[order(f"o{i}", "c", "2020-01-01") for i in range(5)],
        item=items, product=[product_row("p", "A", weight=200.0)], seller=[("s", "X", "S", "g")],
        geo=[("g", 0.0, 0.0)],
    )
    rows = {r.is_top: (r.orders, r.avg_freight, r.avg_distance, r.avg_weight)
            for r in logistics.freight_order_profile(t, k=2).collect()}
    assert rows == {True: (2, 4.5, 0.0, 200.0), False: (3, 2.0, 0.0, 200.0)}
    top = [(r.order_id, r.rank) for r in logistics.top_freight_orders(t, k=2).orderBy("rank").collect()]
    assert top == [("o4", 1), ("o3", 2)]


def test_chi_square_known_value(make_roles):
    # 2x2 table: card 30 of 40 completed, boleto 10 of 40 -> chi2 = 20.0, dof 1
    orders, pays = [], []
    for i in range(40):
        orders.append(order(f"a{i}", "c", "2020-01-01", "delivered" if i < 30 else "canceled"))
        pays.append((f"a{i}", 1, "card", 1, money(1)))
        orders.append(order(f"b{i}", "c", "2020-01-01", "delivered" if i < 10 else "canceled"))
        pays.append((f"b{i}", 1, "boleto", 1, money(1)))
    t = make_roles(order=orders, payment=pays)
    r = feedback.completion_payment_chi2(t).first()
    assert (r.statistic, r.dof) == (20.0, 1)
    assert r.p_value < 1e-3  # exact tail 7.7e-6
    rates = {r.payment_type: r.completion_rate for r in feedback.completion_rate_by_payment(t).collect()}
    assert rates == {"card": 0.75, "boleto": 0.25}


def test_sales_seasonality_index(make_roles):
    # complete months 2020-02..2021-01 plus partial first/last months that must be ignored
    days = ["2020-01-15"] + [f"2020-{m:02d}-01" for m in range(2, 13)] + ["2021-01-01", "2021-01-31", "2021-02-03"]
    orders = [order(f"o{i}", "c", d) for i, d in enumerate(days)]
    items = [(f"o{i}", "p", "s", 1, money(300 if d.startswith("2020-12") else 100), money(1))
             for i, d in enumerate(days)]
    t = make_roles(order=orders, item=items)
    rows = {r.month_of_year: (r.avg_sales, r["index"]) for r in sales.sales_seasonality(t).collect()}
    assert len(rows) == 12
    mean = (10 * 100 + 300 + 200) / 12
    assert rows[12] == (300.0, round(300 / mean, 6))
    assert rows[1] == (200.0, round(200 / mean, 6))
