"""Logistics: freight cost and delivery punctuality (L1-L4).

Scale notes:

* L1 ranks orders by freight from the order-grain freight base first
  (TakeOrderedAndProject), then runs the product/seller/geo joins for the k
  winning orders only; AQE measures the k order ids before it broadcasts them.
* L2 needs features for every order: items meet products, sellers and geo at
  item grain (dimension joins; AQE chooses broadcast or sort-merge from
  measured sizes), then one aggregation on ``order_id``.
* L3/L4 never join reviews or customers at a wider grain than needed: L4
  counts per customer first and maps customers to places afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emporia.functions import regression, stats
from emporia.functions.geo import distance_m
from emporia.functions.money import exact_sum, money_of
from emporia.plans.bases import order_item, order_review
from emporia.sources.roles import Roles


def _order_features(t: Roles, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Per order: items, weight_g, volume_cm3, freight, distance_m (max over items).

    ``items``/``orders`` are (possibly pre-filtered) item and order roles.
    Distance is seller to customer location; unknown geo gives null.
    """
    geo = t.geo.select("geo_key", "lat", "lng")
    sgeo = geo.select(F.col("geo_key").alias("s_geo"), F.col("lat").alias("s_lat"),
                      F.col("lng").alias("s_lng"))
    cgeo = geo.select(F.col("geo_key").alias("c_geo"), F.col("lat").alias("c_lat"),
                      F.col("lng").alias("c_lng"))
    prod = t.product.select(
        "product_id", "weight_g",
        (F.col("length_cm") * F.col("height_cm") * F.col("width_cm")).alias("volume_cm3"))
    # Locations are attached to sellers and customers at dimension grain, so
    # the (large) item and order tables each meet one location table, not two.
    sellers = (t.seller.select("seller_id", F.col("geo_key").alias("s_geo"))
               .join(sgeo, "s_geo", "left").drop("s_geo"))
    buyers = (t.customer.select("customer_id", F.col("geo_key").alias("c_geo"))
              .join(cgeo, "c_geo", "left").drop("c_geo"))
    where = (
        orders.select("order_id", "customer_id")
        .join(buyers, "customer_id", "left")
        .select("order_id", "c_lat", "c_lng")
    )
    lines = (
        items.select("order_id", "product_id", "seller_id", "freight")
        .join(prod, "product_id", "left")
        .join(sellers, "seller_id", "left")
        .join(where, "order_id", "left")
    )
    dist = distance_m(F.col("c_lat"), F.col("c_lng"), F.col("s_lat"), F.col("s_lng"))
    return lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items"),
        exact_sum(F.col("freight"), money_of(t.item, "freight")).alias("freight"),
        F.sum("weight_g").alias("weight_g"),
        F.sum("volume_cm3").alias("volume_cm3"),
        F.max(dist).alias("distance_m"),
    )


def _top_freight(t: Roles, k: int) -> DataFrame:
    """order_id, freight of the k orders with the highest freight (ties: order_id)."""
    return order_item(t).select("order_id", "freight").orderBy(
        F.col("freight").desc_nulls_last(), F.col("order_id")).limit(k)


def top_freight_orders(t: Roles, k: int = 100) -> DataFrame:
    """L1: the k orders with the highest freight and their drivers.

    freight, weight and volume are summed over the order's items; distance is
    the largest seller-to-customer distance among them (null if unknown),
    rounded to metres.  Columns: order_id, freight, distance_km, weight_g,
    volume_cm3, items, rank.
    """
    top = _top_freight(t, k).select("order_id")
    items = t.item.join(top, "order_id", "left_semi")
    orders = t.order.select("order_id", "customer_id").join(top, "order_id", "left_semi")
    feats = _order_features(t, items, orders)
    w = Window.orderBy(F.col("freight").desc_nulls_last(), F.col("order_id"))
    return feats.select(
        "order_id",
        F.col("freight").cast("double").alias("freight"),
        (F.col("distance_m") / F.lit(1000.0)).alias("distance_km"),
        F.col("weight_g").cast("double").alias("weight_g"),
        F.col("volume_cm3").cast("double").alias("volume_cm3"),
        F.col("items").cast("bigint").alias("items"),
        F.row_number().over(w).cast("bigint").alias("rank"),
    )


def freight_order_profile(t: Roles, k: int = 100) -> DataFrame:
    """L2: the top-k freight orders against all other orders with items.

    Two rows (is_top true/false): orders, avg_freight, avg_distance (km, over
    orders with known distance), avg_weight, avg_volume.
    """
    feats = _order_features(t, t.item, t.order)
    # The k winners come from the items alone, as in L1: the features, with
    # their joins, are worked out once.
    top = _top_freight(t, k).select("order_id", F.lit(True).alias("top"))
    flagged = feats.join(top, "order_id", "left").select(
        F.coalesce(F.col("top"), F.lit(False)).alias("is_top"), "freight", "distance_m",
        "weight_g", "volume_cm3")
    agg = flagged.groupBy("is_top").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("freight").alias("freight"), F.count("freight").alias("n_freight"),
        F.sum("distance_m").alias("dist"), F.count("distance_m").alias("n_dist"),
        F.sum("weight_g").alias("weight"), F.count("weight_g").alias("n_weight"),
        F.sum("volume_cm3").alias("volume"), F.count("volume_cm3").alias("n_volume"),
    )
    return agg.select(
        "is_top", F.col("orders").cast("bigint").alias("orders"),
        F.round(stats.ratio(F.col("freight"), F.col("n_freight")), 6).alias("avg_freight"),
        F.round(stats.ratio(F.col("dist"), F.col("n_dist")) / F.lit(1000.0), 6).alias("avg_distance"),
        F.round(stats.ratio(F.col("weight"), F.col("n_weight")), 6).alias("avg_weight"),
        F.round(stats.ratio(F.col("volume"), F.col("n_volume")), 6).alias("avg_volume"),
    )


FREIGHT_TERMS = ("distance_100km", "weight_kg", "volume_dm3", "cross_state")


def freight_drivers(t: Roles) -> DataFrame:
    """L2 as a regression: what drives the freight of an item?

    Ordinary least squares of freight on the distance from seller to buyer (in
    100 km), the product's weight (kg) and volume (dm3) and whether the states
    differ (1 or 0), with a constant, over items whose variables are all known:
    M4's difference between states with distance, weight and volume held
    constant.  Standard errors take items as independent.  The joins with
    sellers and orders give distances and flags; items then meet products as
    sums per product.  A term that the ones before it determine is aliased
    (coefficient null).  Columns: term, coefficient, std_error, t, items, r2.
    """
    geo = t.geo.select("geo_key", "lat", "lng")

    def placed(role, key, p):
        place = geo.select(F.col("geo_key").alias("geo"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
        return role.select(key, F.col("geo_key").alias("geo"), F.col("state").alias(f"{p}_state")).join(place, "geo", "left").drop("geo")

    buyers = t.order.select("order_id", "customer_id").join(placed(t.customer, "customer_id", "c"), "customer_id", "left").drop("customer_id")
    items = t.item.select("order_id", "product_id", "seller_id", F.col("freight").cast("double").alias("y"))
    lines = items.join(placed(t.seller, "seller_id", "s"), "seller_id", "left").join(buyers, "order_id")
    lines = lines.select("product_id", "y", (distance_m(F.col("c_lat"), F.col("c_lng"), F.col("s_lat"), F.col("s_lng")) / 100_000.0).alias("d"),
                         (F.col("s_state") != F.col("c_state")).cast("double").alias("x"))
    lines = lines.where(F.col("y").isNotNull() & F.col("d").isNotNull() & F.col("x").isNotNull())
    y, d, x = F.col("y"), F.col("d"), F.col("x")
    per_product = lines.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum(y).alias("y"), F.sum(d).alias("d"), F.sum(x).alias("x"),
        F.sum(y * y).alias("yy"), F.sum(d * y).alias("dy"), F.sum(x * y).alias("xy"), F.sum(d * d).alias("dd"), F.sum(d * x).alias("dx"))
    volume = F.col("length_cm") * F.col("height_cm") * F.col("width_cm") / 1000.0
    goods = t.product.select("product_id", (F.col("weight_g") / 1000.0).cast("double").alias("w"), volume.cast("double").alias("v"))
    g = per_product.join(goods, "product_id").where(F.col("w").isNotNull() & F.col("v").isNotNull())
    # Weight and volume are constants of a product, so its sums give its part of every moment.
    k, w, v = F.col("k"), F.col("w"), F.col("v")
    of = {"n": k, "sy": y, "syy": F.col("yy"), "sx_0": d, "sx_1": w * k, "sx_2": v * k, "sx_3": x,
          "sxy_0": F.col("dy"), "sxy_1": w * y, "sxy_2": v * y, "sxy_3": F.col("xy"),
          "sxx_0_0": F.col("dd"), "sxx_1_0": w * d, "sxx_1_1": w * w * k, "sxx_2_0": v * d, "sxx_2_1": v * w * k, "sxx_2_2": v * v * k,
          "sxx_3_0": F.col("dx"), "sxx_3_1": w * x, "sxx_3_2": v * x, "sxx_3_3": x}
    m = regression.least_squares(g.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in of.items()]), len(FREIGHT_TERMS))
    terms = [("constant", "c"), *((name, str(i)) for i, name in enumerate(FREIGHT_TERMS))]
    rows = F.array(*[F.struct(F.lit(name).alias("term"), F.col(f"beta_{i}").alias("b"), F.col(f"se_{i}").alias("se")) for name, i in terms])
    return m.select(F.explode(rows).alias("r"), "n", "r2").select(
        "r.term", F.round("r.b", 6).alias("coefficient"), F.round("r.se", 6).alias("std_error"),
        F.round(F.try_divide(F.col("r.b"), F.when(F.col("r.se") != 0, F.col("r.se"))), 4).alias("t"),
        F.col("n").cast("bigint").alias("items"), F.round("r2", 6).alias("r2"))


def late_flag(delivered: Column, promised: Column) -> Column:
    """True if delivered after the promised day, false if on time, null if unknown."""
    return F.to_date(delivered) > F.to_date(promised)


def late_vs_ontime_score(t: Roles) -> DataFrame:
    """L3: do late orders get lower review scores? (Welch t, late minus on-time)

    Unit: a reviewed order whose lateness is known.  One-sided p for "late
    lower".  Columns: n_late, mean_late, n_ontime, mean_ontime, t, df, p_one_sided.
    """
    orders = t.order.select("order_id", late_flag(F.col("delivered_ts"), F.col("promised_ts"))
                            .alias("late")).filter(F.col("late").isNotNull())
    scored = orders.join(order_review(t), "order_id").select(
        "late", F.col("score").cast("double").alias("x"))
    late, ontime = F.col("late"), ~F.col("late")
    m = scored.agg(
        F.count_if(late).alias("n1"), F.avg(F.when(late, F.col("x"))).alias("m1"),
        F.var_samp(F.when(late, F.col("x"))).alias("v1"),
        F.count_if(ontime).alias("n2"), F.avg(F.when(ontime, F.col("x"))).alias("m2"),
        F.var_samp(F.when(ontime, F.col("x"))).alias("v2"))
    w = stats.welch(F.col("n1"), F.col("m1"), F.col("v1"), F.col("n2"), F.col("m2"), F.col("v2"),
                    "less")
    return m.select(
        F.col("n1").cast("bigint").alias("n_late"), F.round("m1", 6).alias("mean_late"),
        F.col("n2").cast("bigint").alias("n_ontime"), F.round("m2", 6).alias("mean_ontime"),
        w["t"].alias("t"), w["df"].alias("df"), w["p_one_sided"].alias("p_one_sided"))


def late_orders_by_city(t: Roles) -> DataFrame:
    """L4: late deliveries by the buyer's city (keyed by state and city).

    delivered_orders counts orders whose lateness is known; late_rate is
    late / delivered; late_share is the city's part of all late orders.
    Columns: state, city, late_orders, delivered_orders, late_rate, late_share.
    """
    late = late_flag(F.col("delivered_ts"), F.col("promised_ts"))
    per_customer = t.order.groupBy("customer_id").agg(
        F.count_if(late).alias("late"), F.count_if(late.isNotNull()).alias("known"))
    per_city = (
        per_customer.join(t.customer.select("customer_id", "state", "city"), "customer_id")
        .groupBy("state", "city").agg(F.sum("late").alias("late"), F.sum("known").alias("known"))
    )
    # The subquery reads the same columns as the query, so both share one exchange.
    both = per_city.agg(F.struct(F.sum("late").alias("late"), F.sum("known").alias("known"))).scalar()
    total = both.getField("late")
    return per_city.select(
        "state", "city",
        F.col("late").cast("bigint").alias("late_orders"),
        F.col("known").cast("bigint").alias("delivered_orders"),
        F.round(stats.ratio(F.col("late"), F.when(F.col("known") != 0, F.col("known"))), 6)
        .alias("late_rate"),
        F.round(stats.ratio(F.col("late"), F.when(total != 0, total)), 6).alias("late_share"),
    )
