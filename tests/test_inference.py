"""Decomposition, least squares, cluster-robust and rank tests, survival, cohorts, Rao-Scott, dispersion: planted cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from emporia.functions import regression
from emporia.operators import customers, feedback, logistics, market, retention, robust, sales
from pyspark.sql import functions as F
from tests.conftest import money, product_row, ts
from tests.test_planted_more import order

# -- decomposition


def monthly(make_roles, values, first=(2015, 1)):
    """One order a month worth ``values`` (cents), on the 1st, and one on the last day, so that all months are complete."""
    rows, items, y, m = [], [], *first
    for i, v in enumerate(values):
        end = (dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1)).isoformat()
        rows += [order(f"a{i}", "c", f"{y}-{m:02d}-01"), order(f"b{i}", "c", end)]
        items.append((f"a{i}", "p", "s", 1, money(v), money(1)))
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return make_roles(order=rows, item=items)


def test_line_times_season_is_recovered(make_roles):
    season = [0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.25, 1.1, 1.0, 0.9, 0.75]
    trend = [1_000_000 * (1 + 0.01 * i) for i in range(60)]
    rows = sales.sales_decomposition(monthly(make_roles, [round(a * season[i % 12], 2) for i, a in enumerate(trend)])).orderBy("month").collect()
    assert len(rows) == 60
    for i, r in enumerate(rows):
        assert r.season == pytest.approx(season[i % 12], abs=1.1e-6)
        if 6 <= i < 54:
            assert r.trend == pytest.approx(trend[i], rel=1e-6) and r.remainder == pytest.approx(1, abs=2e-6)
            assert r.trend_growth is None or r.trend_growth == pytest.approx(trend[i] / trend[i - 1] - 1, abs=2e-6)
        else:
            assert r.trend is None and r.remainder is None
        assert r.adjusted == pytest.approx(trend[i], rel=2e-6)
    # The classical method (one round) leaks some of the trend into the season.
    one = sales.sales_decomposition(monthly(make_roles, [round(a * season[i % 12], 2) for i, a in enumerate(trend)]), rounds=1).orderBy("month").first()
    assert abs(one.season - season[0]) > 1e-5


def test_short_and_empty_series_have_no_season(make_roles):
    rows = sales.sales_decomposition(monthly(make_roles, [100] * 20)).collect()
    assert len(rows) == 20 and all(r.season is None and r.remainder is None for r in rows) and sum(r.trend is not None for r in rows) == 8
    assert sales.sales_decomposition(make_roles()).count() == 0
    zero = sales.sales_decomposition(monthly(make_roles, [0] * 40)).collect()
    assert all(r.season is None and r.adjusted is None for r in zero)
    with pytest.raises(ValueError):
        sales.sales_decomposition(make_roles(), rounds=0)


# -- least squares


def fitted(spark, rows, k):
    df = spark.createDataFrame(rows, ", ".join([f"x{i} double" for i in range(k)] + ["y double"]))
    m = df.agg(*[c.alias(n) for n, c in regression.moments([F.col(f"x{i}") for i in range(k)], F.col("y")).items()])
    return regression.least_squares(m, k).first()


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) * [1, 5, 0.1, 30] + [3, -2, 0, 100]
    y = 2 + x @ [1.5, -0.3, 4, 0.02] + rng.normal(size=200)
    r = fitted(spark, [(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, None)], 4)
    design = np.column_stack([x, np.ones(200)])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(rss[0] / 195 * np.diag(np.linalg.inv(design.T @ design)))
    assert [r.beta_0, r.beta_1, r.beta_2, r.beta_3, r.beta_c] == pytest.approx(beta.tolist(), rel=1e-9)
    assert [r.se_0, r.se_1, r.se_2, r.se_3, r.se_c] == pytest.approx(se.tolist(), rel=1e-8)
    assert r.r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum(), rel=1e-9) and r.n == 200 and r.df == 195


def test_least_squares_leaves_out_what_adds_nothing(spark):
    rows = [(float(i), 2.0 * i + 1, 5.0, float((i * i) % 7), 3.0 * i + (i * i) % 7) for i in range(30)]
    r = fitted(spark, rows, 4)
    assert (r.beta_1, r.se_1, r.beta_2) == (None, None, None)
    assert r.beta_0 == pytest.approx(3) and r.beta_3 == pytest.approx(1) and r.beta_c == pytest.approx(0, abs=1e-8) and r.r2 == pytest.approx(1)
    none = fitted(spark, [(None, None)], 1)
    assert none.n == 0 and none.beta_0 is None and none.beta_c is None


def test_freight_drivers_find_the_planted_coefficients(make_roles):
    rng = random.Random(4)
    cust = [(f"c{i}", f"c{i}", "X", f"S{i % 3}", f"g{i}") for i in range(12)]
    sell = [(f"s{i}", "X", f"S{i % 4}", f"h{i}") for i in range(8)]
    geo = [(f"g{i}", -20.0 + i, -50.0) for i in range(12)] + [(f"h{i}", -25.0, -50.0 + i) for i in range(8)]
    prod = [(f"p{i}", "A", 1, 1, 1, 100.0 * (i + 1), 10.0, 10.0 + (i * i) % 5, 10.0 + i % 3) for i in range(10)] + [("p_", "A", 1, 1, 1, None, 1.0, 1.0, 1.0)]

    def distance(c, s):
        (la, lo), (lb, lp) = next((g[1], g[2]) for g in geo if g[0] == c[4]), next((g[1], g[2]) for g in geo if g[0] == s[3])
        a, b = math.radians(la), math.radians(lb)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lp - lo) / 2) ** 2
        return round(2 * 6371.0 * math.asin(math.sqrt(h)) * 1000) / 100_000

    orders, items = [], []
    for k in range(300):
        c, s, p = rng.choice(cust), rng.choice(sell), prod[rng.randrange(10)]
        freight = 5 + 2 * distance(c, s) + 3 * p[5] / 1000 + 1.5 * p[6] * p[7] * p[8] / 1000 + 4 * (c[3] != s[2])
        orders.append(order(f"o{k}", c[0], "2020-01-01"))
        items.append((f"o{k}", p[0], s[0], 1, money(1), money(round(freight, 2))))
    items.append(("o1", "p_", "s1", 1, money(1), money(999)))  # unknown weight: left out
    t = make_roles(customer=cust, seller=sell, geo=geo, product=prod, order=orders, item=items)
    got = {r.term: r for r in logistics.freight_drivers(t).collect()}
    want = {"constant": 5, "distance_100km": 2, "weight_kg": 3, "volume_dm3": 1.5, "cross_state": 4}
    for term, value in want.items():
        assert got[term].coefficient == pytest.approx(value, abs=0.02) and got[term].std_error < 0.02 and got[term].items == 300
    assert got["constant"].r2 > 0.9999
    empty = logistics.freight_drivers(make_roles()).collect()
    assert len(empty) == 5 and all(r.coefficient is None and r.items == 0 for r in empty)


# -- cluster-robust


def test_clustered_equals_plain_without_clusters(spark):
    rng = random.Random(6)
    rows = [(1, x, x * x, 0, 0.0, 0.0) if rng.random() < 0.4 else (0, 0.0, 0.0, 1, x, x * x) for x in (rng.gauss(3, 2) for _ in range(300))]
    names = "n1 int, s1 double, q1 double, n2 int, s2 double, q2 double"
    one = robust.clustered_difference(spark.createDataFrame(rows, names), "greater").first()
    assert one.design_effect == pytest.approx(1, abs=1e-6) and one.se_cluster == pytest.approx(one.se_plain, abs=2e-9) and one.clusters == 300
    four = [tuple(4 * v for v in r) for r in rows]  # every unit four times in its order
    many = robust.clustered_difference(spark.createDataFrame(four, names), "greater").first()
    assert many.design_effect == pytest.approx(4, abs=1e-5) and (many.m1, many.m2) == (one.m1, one.m2) and many.z == pytest.approx(one.z, abs=2e-6)
    less = robust.clustered_difference(spark.createDataFrame(rows, names), "less").first()
    assert less.p_one_sided == pytest.approx(1 - one.p_one_sided, abs=2e-9) and less.z == one.z
    few = robust.clustered_difference(spark.createDataFrame(rows[:1], names), "greater").first()
    assert (few.z, few.p_one_sided, few.se_cluster) == (None, None, None)


def test_clustered_freight_and_reviews(make_roles):
    cust = [("c1", "c1", "X", "A", "g"), ("c2", "c2", "Y", "B", "g")]
    sell = [("s", "X", "A", "g")]
    orders, items, reviews = [], [], []
    rng = random.Random(8)
    for k in range(60):
        orders.append(order(f"o{k}", f"c{k % 2 + 1}", "2020-01-01"))
        f = round(10 + 3 * (k % 2) + rng.random(), 2)
        items += [(f"o{k}", f"p{j}", "s", 1, money(1), money(f)) for j in range(3)]  # three items of one parcel
    t = make_roles(customer=cust, seller=sell, order=orders, item=items)
    m4, r = market.cross_state_freight(t).first(), robust.cross_state_freight_clustered(t).first()
    assert (r.n_cross, r.mean_cross, r.n_same) == (m4.n_cross, m4.mean_cross, m4.n_same) and r.clusters == 60
    assert r.design_effect == pytest.approx(3, abs=1e-5) and r.z < m4.t and r.p_one_sided < 1e-9
    # Slow products share bad reviews with the others of their orders.
    items = [(f"o{k}", p, "s", u, money(1), money(1)) for k in range(40) for p, u in ((f"hot{k % 3}", 50), (f"slow{k % 4}", 1), (f"mid{k % 6}", 9))]
    reviews = [(f"o{k}", 1 if k % 5 == 0 else 5, None) for k in range(40)] + [("o1", None, ts("2021-01-01"))]
    t = make_roles(order=[order(f"o{k}", "c", "2020-01-01") for k in range(40)], item=items, review=reviews)
    s6, r = sales.hot_slow_bad_review_rate(t).first(), robust.hot_slow_bad_review_clustered(t).first()
    assert (r.n_slow, r.n_hot) == (s6.n_slow, s6.n_hot) and r.mean_slow == s6.rate_slow and r.mean_hot == s6.rate_hot


# -- ranks


def test_mann_whitney_equals_pairs(spark):
    rng = random.Random(5)
    a, b = [rng.randint(1, 5) for _ in range(60)], [min(5, rng.randint(1, 6)) for _ in range(45)]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n = len(a) + len(b)
    ties = sum(k ** 3 - k for k in ((a + b).count(v) for v in range(1, 6)))
    z = (u - len(a) * len(b) / 2) / math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    hist = spark.createDataFrame([(v, a.count(v), b.count(v)) for v in range(1, 6)], "x int, k1 bigint, k2 bigint")
    r = robust.mann_whitney(hist, "less").first()
    assert (r.n1, r.n2, r.u) == (60, 45, u) and r.z == pytest.approx(z, abs=1e-6)
    assert r.p_one_sided == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=2e-9) and r.superiority == pytest.approx(u / 2700, abs=1e-6)
    same = robust.mann_whitney(spark.createDataFrame([(3, 5, 7)], "x int, k1 bigint, k2 bigint"), "less").first()
    assert (same.z, same.superiority) == (None, 0.5)
    assert robust.mann_whitney(hist.limit(0), "less").first().n1 == 0


def test_rank_companions(make_roles):
    orders, reviews, cust = [], [], []
    for k in range(40):
        cust.append((f"c{k}", f"P{k}", "X", "S", "g"))
        for j in range(2 if k % 2 else 1):  # odd buyers come back and score higher
            oid = f"o{k}_{j}"
            late = k % 4 == 0
            orders.append((oid, f"c{k}", "delivered", ts("2020-01-01"), ts("2020-02-01" if late else "2020-01-05"), ts("2020-01-10")))
            reviews.append((oid, (2 if late else 3) + (k % 2) + j, None))
    t = make_roles(customer=cust, order=orders, review=reviews)
    r = robust.repeat_vs_single_rank(t).first()
    assert (r.n_repeat, r.n_single) == (20, 20) and r.superiority == 1.0 and r.p_one_sided < 1e-6
    late = robust.late_vs_ontime_rank(t).first()
    l3 = logistics.late_vs_ontime_score(t).first()
    assert (late.n_late, late.n_ontime) == (l3.n_late, l3.n_ontime) and late.superiority < 0.1 and late.p_one_sided < 1e-4


# -- survival and cohorts


def test_survival_equals_a_hand_worked_case(make_roles):
    # P: 0, 10 days, then censored at day 100 (90 days); Q: one order on day 60, censored after 40; R: day 100 twice.
    day = lambda d: (dt.date(2020, 1, 1) + dt.timedelta(days=d)).isoformat()
    t = make_roles(customer=[("c1", "P", "X", "S", "g"), ("c2", "P", "X", "S", "g"), ("c3", "Q", "X", "S", "g"), ("c4", "R", "X", "S", "g")],
                   order=[order("a", "c1", day(0)), order("b", "c2", day(10)), order("c", "c3", day(60)), order("d", "c4", day(100)), order("e", "c4", day(100))])
    rows = {r.days: r for r in retention.repurchase_survival(t).collect()}
    # Spells: 10 (event), 90 (censored), 40 (censored), 0 (event), 0 (censored).
    assert {d: (r.at_risk, r.events, r.survival) for d, r in rows.items()} == {0: (5, 1, 0.8), 10: (3, 1, pytest.approx(0.8 * 2 / 3, abs=1e-6))}
    assert rows[0].std_error == pytest.approx(0.8 * math.sqrt(1 / (5 * 4)), abs=1e-6)
    assert rows[10].std_error == pytest.approx(0.8 * 2 / 3 * math.sqrt(1 / 20 + 1 / 6), abs=1e-6)
    s = retention.repurchase_survival_summary(t).first()
    assert (s.spells, s.events, s.median_days, s.within_365) == (5, 2, None, None) and s.within_30 == pytest.approx(1 - 0.8 * 2 / 3, abs=1e-6)
    empty = retention.repurchase_survival_summary(make_roles()).first()
    assert (empty.spells, empty.events, empty.median_days) == (0, 0, None) and retention.repurchase_survival(make_roles()).count() == 0


def test_survival_ends_at_zero_when_nobody_is_left(make_roles):
    t = make_roles(customer=[("c", "P", "X", "S", "g")], order=[order("a", "c", "2020-01-01"), order("b", "c", "2020-01-08")])
    # Spells: 7 days (event) and 0 days (censored): at 7 days one is at risk and ends.
    r = retention.repurchase_survival(t).first()
    assert (r.days, r.at_risk, r.survival, r.std_error) == (7, 1, 0.0, None)
    assert retention.repurchase_survival_summary(t).first().median_days == 7


def test_cohorts(make_roles):
    t = make_roles(customer=[("c1", "P", "X", "S", "g"), ("c2", "P", "X", "S", "g"), ("c3", "Q", "X", "S", "g"), ("c4", "R", "X", "S", "g")],
                   order=[order("a", "c1", "2020-01-05"), order("b", "c2", "2020-03-09"), order("c", "c1", "2020-01-07"), order("d", "c3", "2020-01-31"),
                          order("e", "c4", "2020-03-01")])
    rows = {(r.cohort.month, r.month_offset): (r.buyers, r.cohort_size, r.retention, r.complete) for r in retention.cohort_retention(t).collect()}
    assert rows == {(1, 0): (2, 2, 1.0, True), (1, 1): (0, 2, 0.0, True), (1, 2): (1, 2, 0.5, False), (3, 0): (1, 1, 1.0, False)}
    assert sum(v[0] for (_, k), v in rows.items() if k == 0) == customers.repeat_rate(t).first().customers
    assert retention.cohort_retention(make_roles()).count() == 0


# -- Rao-Scott and dispersion


def paid(make_roles, methods_of, done_of, n=200):
    rows = [("o%d" % k, "c", "delivered" if done_of(k) else "shipped", ts("2020-01-01"), None, None) for k in range(n)]
    pays = [("o%d" % k, i, m, 1, money(1)) for k in range(n) for i, m in enumerate(methods_of(k))]
    return make_roles(order=rows, payment=pays)


def test_rao_scott(make_roles):
    rng = random.Random(2)
    done = [rng.random() < 0.6 for _ in range(200)]
    t = paid(make_roles, lambda k: ["abc"[k % 3]], lambda k: done[k])
    plain, r = feedback.completion_payment_chi2(t).first(), feedback.completion_payment_rao_scott(t).first()
    assert r.design_effect == 1.0 and (r.statistic, r.dof) == (plain.statistic, plain.dof)
    assert r.adjusted == pytest.approx(plain.statistic, abs=2e-6) and r.p_value == pytest.approx(plain.p_value, abs=1e-8)
    two = paid(make_roles, lambda k: ["a", "b"] if k % 2 else ["c"], lambda k: done[k])
    plain, r = feedback.completion_payment_chi2(two).first(), feedback.completion_payment_rao_scott(two).first()
    # Brute force: the contribution of every order to every method's departure, squared.
    units = [(k, m, float(done[k])) for k in range(200) for m in (["a", "b"] if k % 2 else ["c"])]
    n, q = len(units), sum(y for *_, y in units) / len(units)
    clusters = plain_units = 0.0
    for m in "abc":
        share = sum(x == m for _, x, _ in units) / n
        h = sum(y for _, x, y in units if x == m) / n - share * q
        psi = [(k, ((x == m) - share) * (y - q) - h) for k, x, y in units]
        per_order = {}
        for k, v in psi:
            per_order[k] = per_order.get(k, 0.0) + v
        clusters += sum(v * v for v in per_order.values()) / share
        plain_units += sum(v * v for _, v in psi) / share
    assert r.statistic == plain.statistic and r.design_effect == pytest.approx(clusters / plain_units, abs=1e-6) and r.design_effect < 0.8
    assert r.adjusted == pytest.approx(r.statistic * plain_units / clusters, abs=1e-5)
    # Orders whose methods come in pairs with like outcomes carry less information than as many single ones.
    even = paid(make_roles, lambda k: ["a", "b"] if k % 4 < 2 else ["a", "c"], lambda k: done[k])
    assert feedback.completion_payment_rao_scott(even).first().design_effect != 1.0
    one = feedback.completion_payment_rao_scott(paid(make_roles, lambda k: ["a"], lambda k: done[k])).first()
    assert tuple(one) == (None, None, None, None, None) == tuple(feedback.completion_payment_rao_scott(make_roles()).first())
    all_done = feedback.completion_payment_rao_scott(paid(make_roles, lambda k: ["abc"[k % 3]], lambda k: True)).first()
    assert all_done.statistic is None and all_done.p_value is None


def reviewed(make_roles, rates, n):
    """Sellers with n reviews each; the first round(rate n) of them bad."""
    items, reviews, orders = [], [], []
    for s, rate in enumerate(rates):
        for k in range(n):
            oid = f"o{s}_{k}"
            orders.append(order(oid, "c", "2020-01-01"))
            items.append((oid, "p", f"s{s:03d}", 1, money(1), money(1)))
            reviews.append((oid, 1 if k < round(rate * n) else 5, None))
    return make_roles(order=orders, item=items, review=reviews)


def test_dispersion_and_flags(make_roles):
    rng = random.Random(9)
    even = reviewed(make_roles, [sum(rng.random() < 0.2 for _ in range(40)) / 40 for _ in range(40)], 40)
    d = feedback.seller_bad_review_dispersion(even).first()
    assert d.sellers == 40 and d.dof == 39 and d.p_value > 0.01 and d.rho < 0.02
    assert not any(r.flagged for r in feedback.seller_bad_review_flags(even).collect())
    bad = reviewed(make_roles, [0.1] * 36 + [0.6] * 4, 40)
    d = feedback.seller_bad_review_dispersion(bad).first()
    n, p = 1600, (36 * 4 + 4 * 24) / 1600
    x2 = sum(40 * (r - p) ** 2 for r in [0.1] * 36 + [0.6] * 4) / (p * (1 - p))
    rho = (x2 - 39) / (n - 40 * 1600 / n - 39)
    assert d.statistic == pytest.approx(x2, abs=1e-5) and d.rho == pytest.approx(rho, abs=1e-8) and d.p_value < 1e-9
    assert d.prior_reviews == pytest.approx(1 / rho - 1, abs=1e-3)
    rows = {r.seller_id: r for r in feedback.seller_bad_review_flags(bad).collect()}
    assert {s for s, r in rows.items() if r.flagged} == {f"s{i:03d}" for i in range(36, 40)}
    m = 1 / rho - 1
    assert rows["s036"].shrunk_rate == pytest.approx((24 + p * m) / (40 + m), abs=1e-6) and p < rows["s036"].shrunk_rate < 0.6
    same = feedback.seller_bad_review_flags(reviewed(make_roles, [0.5] * 3, 10)).collect()
    assert all(r.shrunk_rate == 0.5 and not r.flagged for r in same)
    assert feedback.seller_bad_review_flags(make_roles()).count() == 0
    empty = feedback.seller_bad_review_dispersion(make_roles()).first()
    assert (empty.sellers, empty.statistic, empty.p_value) == (0, None, None)
