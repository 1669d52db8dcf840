"""Market and geography: regional penetration and cross-state trade (M1-M4).

Scale notes: order-grain facts are counted per customer first and mapped to
places afterwards, so the customer join runs at customer grain; distinct
buyers per city are counted from a (state, city, person) pre-aggregate, not
with a distinct aggregate over orders.  Cross-state flags need the seller's
and the buyer's state on every item: the item side meets sellers (a
dimension) and then orders on ``order_id``; the per-order "any item crosses"
flag is an aggregation that reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.functions.money import exact_sum, money_of
from emporia.plans.bases import latest_periods, order_item, order_pay
from emporia.sources.roles import Roles

MONEY_SUM = "decimal(38,2)"


def _city_facts(t: Roles, grain: str | None = None) -> DataFrame:
    """state, city, orders, sales, order_amount (exact), customers (distinct persons).

    With a grain also ``before`` and ``recent``: orders of the last two complete periods.
    """
    counts = {"orders": F.count(F.lit(1))}
    if grain:
        kind = t.order.schema["purchase_ts"].dataType
        prev, cur, nxt = (c.cast(kind) for c in latest_periods(t, grain))
        ts = F.col("purchase_ts")
        counts |= {"before": F.count_if((ts >= prev) & (ts < cur)), "recent": F.count_if((ts >= cur) & (ts < nxt))}
    per_order = (
        t.order.select("order_id", "customer_id", *(["purchase_ts"] if grain else []))
        .join(order_item(t).select("order_id", "sales"), "order_id", "left")
        .join(order_pay(t).select("order_id", "order_amount"), "order_id", "left")
    )
    per_customer = per_order.groupBy("customer_id").agg(
        *[c.alias(name) for name, c in counts.items()],
        F.sum("sales").alias("sales"),
        F.sum("order_amount").alias("order_amount"))
    per_person = (
        per_customer.join(t.customer.select("customer_id", "person_id", "state", "city"), "customer_id")
        .groupBy("state", "city", "person_id")
        .agg(*[F.sum(name).alias(name) for name in counts], F.sum("sales").alias("sales"),
             F.sum("order_amount").alias("order_amount"))
    )
    zero = F.lit(0).cast(MONEY_SUM)
    return per_person.groupBy("state", "city").agg(
        *[F.sum(name).alias(name) for name in counts],
        F.coalesce(F.sum("sales"), zero).alias("sales"),
        F.coalesce(F.sum("order_amount"), zero).alias("order_amount"),
        F.count(F.lit(1)).alias("customers"))


def city_penetration(t: Roles) -> DataFrame:
    """M1: orders, sales and distinct buyers per (state, city).

    Every order counts; cities whose orders have no items keep sales 0.
    Columns: state, city, orders, sales, customers.
    """
    return _city_facts(t).select(
        "state", "city", F.col("orders").cast("bigint").alias("orders"),
        F.col("sales").cast("double").alias("sales"),
        F.col("customers").cast("bigint").alias("customers"))


def low_penetration_high_potential(t: Roles, order_q: float = 0.5, aov_q: float = 0.75,
                                   min_orders: int = 1, grain: str = "quarter") -> DataFrame:
    """M2: cities with few orders but a high spend per order.

    Kept: orders <= the ``order_q`` percentile of orders over cities, aov >=
    the ``aov_q`` percentile of aov, and orders >= ``min_orders``, where
    aov = order amount / orders.  Cut-offs are exact percentiles over the
    per-city table (one row per city), applied as a scalar subquery.
    ``order_growth`` is the city's orders of the latest complete period against
    the period before (null without orders there).  Columns: state, city,
    orders, sales, customers, aov, order_growth.
    """
    cities = _city_facts(t, grain).select(
        "state", "city", "orders", "sales", "customers", "before", "recent",
        stats.ratio(F.col("order_amount"), F.col("orders")).alias("aov"))
    cut = cities.agg(F.struct(
        F.percentile(F.col("orders"), F.lit(order_q)).alias("max_orders"),
        F.percentile(F.col("aov"), F.lit(aov_q)).alias("min_aov"),
        # Not used, but read: the subquery then has the same columns as the query and shares its exchanges.
        F.sum("sales").alias("sales"), F.sum("customers").alias("customers"),
        F.sum("before").alias("before"), F.sum("recent").alias("recent"))).scalar()
    kept = cities.filter(
        (F.col("orders") <= cut.getField("max_orders")) & (F.col("aov") >= cut.getField("min_aov"))
        & (F.col("orders") >= min_orders))
    return kept.select(
        "state", "city", F.col("orders").cast("bigint").alias("orders"),
        F.col("sales").cast("double").alias("sales"),
        F.col("customers").cast("bigint").alias("customers"),
        F.round("aov", 6).alias("aov"),
        F.round(stats.ratio(F.col("recent"), F.when(F.col("before") != 0, F.col("before"))) - 1.0, 6).alias("order_growth"))


def _item_states(t: Roles) -> DataFrame:
    """Items of known orders with cross: seller state differs from buyer state, null if either is unknown."""
    sellers = t.seller.select("seller_id", F.col("state").alias("s_state"))
    buyers = (
        t.order.select("order_id", "customer_id")
        .join(t.customer.select("customer_id", F.col("state").alias("c_state")), "customer_id", "left")
        .select("order_id", "c_state")
    )
    return (
        t.item.join(sellers, "seller_id", "left")
        .join(buyers, "order_id")
        .withColumn("cross", F.col("s_state") != F.col("c_state"))
    )


def cross_state_order_share(t: Roles) -> DataFrame:
    """M3: share of orders with at least one item sold across state lines.

    Orders without items are excluded, and so are orders none of whose items
    has both states known; they are counted as ``unknown_orders``.  One row:
    orders, cross_orders, share, unknown_orders.
    """
    per_order = _item_states(t).groupBy("order_id").agg(
        F.max(F.col("cross").cast("int")).alias("cross"))
    agg = per_order.agg(F.count("cross").alias("orders"),
                        F.count_if(F.col("cross") == 1).alias("cross_orders"),
                        F.count_if(F.col("cross").isNull()).alias("unknown_orders"))
    return agg.select(
        F.col("orders").cast("bigint").alias("orders"),
        F.col("cross_orders").cast("bigint").alias("cross_orders"),
        F.round(stats.ratio(F.col("cross_orders"), F.col("orders")), 6).alias("share"),
        F.col("unknown_orders").cast("bigint").alias("unknown_orders"))


def cross_state_freight(t: Roles) -> DataFrame:
    """M4: is freight per item higher when seller and buyer are in different states?

    Unit: the item (items of one order are not independent, so p is
    optimistic).  Welch t for cross minus same, one-sided (cross higher).
    per_kg_* (freight / kg over items of known weight) is a control for heavy
    goods, which confound distance.  Items with an unknown state are in
    neither group (``n_unknown``).  Items meet the product role as (product,
    cross) sums.  Columns: n_cross, mean_cross, n_same, mean_same,
    per_kg_cross, per_kg_same, n_unknown, t, df, p_one_sided.
    """
    fs = money_of(t.item, "freight")
    x = F.col("freight").cast("double")
    per_product = _item_states(t).groupBy("product_id", "cross").agg(
        F.count(F.lit(1)).alias("n"), exact_sum(F.col("freight"), fs).alias("s"), F.count("freight").alias("k"),
        F.var_pop(x).alias("var")).withColumn("mean", stats.ratio(F.col("s"), F.col("k")))
    rows = per_product.join(t.product.select("product_id", "weight_g"), "product_id", "left")
    # Squared deviations of a side: those inside its products, and those of the products' means.
    k, mean = F.col("k"), F.col("mean")
    between = F.sum(k * mean * mean) - F.sum(k * mean) * F.sum(k * mean) / F.sum("k")  # products without freight have no mean
    sides = rows.groupBy("cross").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"),
        F.when(F.sum("k") >= 2, (F.sum(k * F.col("var")) + between) / (F.sum("k") - 1)).alias("v"),
        F.sum(F.when(F.col("weight_g").isNotNull(), F.col("s"))).alias("f"), F.sum(F.col("weight_g") * F.col("n")).alias("w"))

    def of(col, cross):  # three rows at most: true, false, unknown
        return F.max(F.when(F.col("cross").eqNullSafe(F.lit(cross).cast("boolean")), F.col(col)))

    m = sides.agg(*[of(c, side).alias(f"{c}{i}") for c in ("s", "v", "f", "w") for i, side in ((1, True), (2, False))],
                  *[F.coalesce(of("n", side), F.lit(0)).alias(f"n{i}") for i, side in ((0, None), (1, True), (2, False))])
    m = m.select("*", stats.ratio(F.col("s1"), F.col("n1")).alias("m1"),
                 stats.ratio(F.col("s2"), F.col("n2")).alias("m2"))
    w = stats.welch(F.col("n1"), F.col("m1"), F.col("v1"), F.col("n2"), F.col("m2"), F.col("v2"),
                    "greater")
    return m.select(
        F.col("n1").cast("bigint").alias("n_cross"), F.round("m1", 6).alias("mean_cross"),
        F.col("n2").cast("bigint").alias("n_same"), F.round("m2", 6).alias("mean_same"),
        F.round(stats.ratio(F.col("f1"), F.col("w1") / F.lit(1000.0)), 6).alias("per_kg_cross"),
        F.round(stats.ratio(F.col("f2"), F.col("w2") / F.lit(1000.0)), 6).alias("per_kg_same"),
        F.col("n0").cast("bigint").alias("n_unknown"),
        w["t"].alias("t"), w["df"].alias("df"), w["p_one_sided"].alias("p_one_sided"))
