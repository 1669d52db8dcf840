"""Sales and products: trend, seasonality, category ranking, hot and slow products.

Scale notes: sales are reduced to order grain before meeting the order role,
so the only large join is order-grain x order-grain on ``order_id``.  Period
series and category rankings are windows over tiny aggregates (one row per
period or category).  Thresholds (percentile cut-offs, the latest complete
period, totals) are one-row aggregates applied as uncorrelated scalar
subqueries (``DataFrame.scalar()``): computed once, no join, nothing
collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.functions.dates import GRAINS, add_periods, period_spine, period_start
from emporia.functions.money import exact_sum, money_of
from emporia.plans.bases import latest_periods, order_item, order_review, with_category
from emporia.sources.roles import Roles

HOT, MID, SLOW = "hot", "mid", "slow"


def _period_sales(t: Roles, grain: str) -> DataFrame:
    """period, sales (exact decimal, 0 for empty periods), complete (bool).

    A period is complete when the order history covers it from its first to
    its last day; only the first and last period can be partial.
    """
    orders = t.order.select("order_id", F.to_date("purchase_ts").alias("day"))
    per_order = orders.join(order_item(t).select("order_id", "sales"), "order_id", "left")
    per_period = per_order.groupBy(period_start(F.col("day"), grain).alias("period")).agg(
        F.sum("sales").alias("sales"), F.min("day").alias("lo"), F.max("day").alias("hi"))
    # Calendar bounds from the per-period rows (tens to hundreds), not a second scan.
    bounds = per_period.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
        "lo", "hi", period_start(F.col("lo"), grain).alias("plo"),
        period_start(F.col("hi"), grain).alias("phi"))
    per_period = per_period.select("period", "sales")
    spine = period_spine(bounds, "plo", "phi", grain, keep=("lo", "hi"))
    end = F.date_sub(add_periods(F.col("period"), 1, grain), 1)
    return spine.join(per_period, "period", "left").select(
        "period",
        F.coalesce(F.col("sales"), F.lit(0).cast("decimal(38,2)")).alias("sales"),
        ((F.col("period") >= F.col("lo")) & (end <= F.col("hi"))).alias("complete"),
    )


def sales_growth(t: Roles, grain: str = "month") -> DataFrame:
    """Period-on-period sales growth (previous calendar period, gaps as 0).

    growth = sales / prev_sales - 1; null for the first period or a zero base.
    The period column is named after the grain.  Columns: <grain>, sales,
    prev_sales, growth, complete.
    """
    ps = _period_sales(t, grain)
    # One row per calendar period: a tiny single-partition window.
    prev = F.lag("sales").over(Window.orderBy("period"))
    s = ps.select("period", "sales", prev.alias("prev"), "complete")
    growth = stats.ratio(F.col("sales"), F.when(F.col("prev") != 0, F.col("prev"))) - F.lit(1.0)
    return s.select(
        F.col("period").alias(grain),
        F.col("sales").cast("double").alias("sales"),
        F.col("prev").cast("double").alias("prev_sales"),
        F.round(growth, 6).alias("growth"),
        "complete",
    )


def sales_seasonality(t: Roles) -> DataFrame:
    """Month-of-year sales index over complete months.

    index = mean sales of that calendar month / mean sales of all complete
    months.  Columns: month_of_year, avg_sales, index.
    """
    ps = _period_sales(t, "month").filter(F.col("complete"))
    by_moy = ps.groupBy(F.month("period").alias("moy")).agg(
        F.sum("sales").alias("s"), F.count(F.lit(1)).alias("n"))
    # At most 12 month-of-year rows: the overall mean is a tiny window over them.
    everything = Window.partitionBy()
    overall = stats.ratio(F.sum("s").over(everything), F.sum("n").over(everything))
    avg_sales = stats.ratio(F.col("s"), F.col("n"))
    return by_moy.select(
        F.col("moy").cast("bigint").alias("month_of_year"),
        F.round(avg_sales, 6).alias("avg_sales"),
        F.round(F.try_divide(avg_sales, F.when(overall != 0, overall)), 6).alias("index"),
    )


def sales_decomposition(t: Roles, rounds: int = 6) -> DataFrame:
    """S2 with the trend taken out: monthly sales = trend x season x remainder, over complete months.

    The trend is a centred 2 x 12 moving average (weights 1/24, 1/12 ... 1/12,
    1/24), null in the first and last six months.  The season of a calendar
    month is the mean ratio of its sales to the trend, normalised so that the
    twelve average 1; it is null for all unless each of the twelve has such a
    ratio.  A plain moving average bends with the season where the trend is
    steep, so the trend is taken again from the sales divided by the season,
    ``rounds`` times in all (one round is the classical method); sales that are
    a straight line times a season come apart exactly.
    ``adjusted`` = sales / season; ``trend_growth`` is the trend's change to the
    month before.  Columns: month, sales, trend, season, remainder, adjusted,
    trend_growth.
    """
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    ps = _period_sales(t, "month").where("complete").select("period", F.col("sales").cast("double").alias("sales"))
    # One row per calendar month: all windows are tiny.
    near = Window.orderBy("period").rowsBetween(-6, 6)
    inner = Window.orderBy("period").rowsBetween(-5, 5)
    everything, same_month = Window.partitionBy(), Window.partitionBy("moy")
    s = ps.select("period", "sales", F.month("period").alias("moy"), F.lit(1.0).alias("season"))
    s = s.withColumn("rows", F.count(F.lit(1)).over(same_month))
    for _ in range(rounds):
        plain = F.try_divide("sales", F.col("season"))
        average = (F.sum("plain").over(near) + F.sum("plain").over(inner)) / 24.0
        s = s.withColumn("plain", plain).withColumn("trend", F.when((F.count("plain").over(near) == 13), average))
        s = s.withColumn("mean", F.avg(F.try_divide(F.col("sales"), F.when(F.col("trend") != 0, F.col("trend")))).over(same_month))
        # Each of the twelve means counts once: its rows share a weight of 1.
        whole = F.sum(F.col("mean") / F.col("rows")).over(everything)
        months = F.sum(F.when(F.col("mean").isNotNull(), 1.0 / F.col("rows"))).over(everything)
        s = s.withColumn("next", F.when((F.round(months, 6) == 12.0) & (whole != 0), F.col("mean") * 12.0 / whole))
        s = s.withColumn("season", F.coalesce(F.when(F.col("next") != 0, F.col("next")), F.lit(1.0)))
    season = F.col("next")
    growth = F.try_divide(F.col("trend"), F.lag("trend").over(Window.orderBy("period"))) - 1.0
    return s.select(
        F.col("period").alias("month"), "sales", F.round("trend", 2).alias("trend"), F.round(season, 6).alias("season"),
        F.round(F.try_divide(F.col("sales"), F.col("trend") * season), 6).alias("remainder"),
        F.round(F.try_divide(F.col("sales"), season), 2).alias("adjusted"), F.round(growth, 6).alias("trend_growth"))


def top_categories_share(t: Roles, n: int = 10) -> DataFrame:
    """S3: top n categories by sales with their share of *all* sales.

    The share denominator is computed before the limit.  Columns: category,
    sales, share, rank.
    """
    # Items are summed to products before they meet the product role.
    per_product = t.item.groupBy("product_id").agg(exact_sum(F.col("price"), money_of(t.item, "price")).alias("sales"))
    agg = with_category(t, per_product).groupBy("category").agg(F.sum("sales").alias("sales"))
    share = stats.ratio(F.col("sales"), F.col("total"))
    ranked = stats.with_total(agg, "sales", "total").select("category", "sales", share.alias("share"))
    top = ranked.orderBy(F.col("sales").desc(), F.col("category")).limit(n)
    w = Window.orderBy(F.col("sales").desc(), F.col("category"))
    return top.select(
        "category", F.col("sales").cast("double").alias("sales"),
        F.round("share", 6).alias("share"), F.row_number().over(w).cast("bigint").alias("rank"))


def fastest_growing_categories(t: Roles, n: int = 10, grain: str = "quarter",
                               min_base: int = 1) -> DataFrame:
    """Top n categories by unit growth, latest complete period vs the one before.

    A period is complete when its last day is not after the latest purchase
    date.  Categories with fewer than ``min_base`` units in the earlier period
    (including new ones) have no meaningful rate and are left out.
    Columns: category, period, prev_units, cur_units, growth, rank.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {sorted(GRAINS)}")
    prev, cur, nxt = latest_periods(t, grain)
    # Bounds in the type of the column itself, so that the filter reaches the scan.
    kind = t.order.schema["purchase_ts"].dataType
    ts = F.col("purchase_ts")
    window_orders = (
        t.order.select("order_id", "purchase_ts")
        .filter((ts >= prev.cast(kind)) & (ts < nxt.cast(kind)))
        .select("order_id", (ts >= cur.cast(kind)).alias("is_cur"))
    )
    per_product = t.item.join(window_orders, "order_id").groupBy("product_id").agg(
        F.sum(F.when(~F.col("is_cur"), F.col("units")).otherwise(0)).alias("prev_units"),
        F.sum(F.when(F.col("is_cur"), F.col("units")).otherwise(0)).alias("cur_units"))
    agg = with_category(t, per_product).groupBy("category").agg(
        F.sum("prev_units").alias("prev_units"), F.sum("cur_units").alias("cur_units"),
    ).filter(F.col("prev_units") >= F.lit(max(min_base, 1))).withColumn("period", cur)
    growth = stats.ratio(F.col("cur_units"), F.col("prev_units")) - F.lit(1.0)
    g = agg.select("category", "period", "prev_units", "cur_units", growth.alias("growth"))
    top = g.orderBy(F.col("growth").desc(), F.col("category")).limit(n)
    w = Window.orderBy(F.col("growth").desc(), F.col("category"))
    return top.select(
        "category", "period",
        F.col("prev_units").cast("bigint").alias("prev_units"),
        F.col("cur_units").cast("bigint").alias("cur_units"),
        F.round("growth", 6).alias("growth"),
        F.row_number().over(w).cast("bigint").alias("rank"),
    )


def _product_units(t: Roles) -> DataFrame:
    return t.item.groupBy("product_id").agg(F.sum("units").alias("units"))


def _class_by_units(hist: DataFrame, q: float) -> Column:
    """Class of a histogram row (one row per distinct unit total, frequency ``k``).

    Cut-offs are exact percentiles (linear interpolation) of units over
    products, weighted by ``k``.  Distinct unit totals are distinct positive
    integers summing to at most all units sold, so the histogram has at most
    sqrt(2 x units) rows: the windows below are small by construction.
    Slow is tested first, so when both cut-offs coincide a product is hot only
    above them.
    """
    everything = Window.partitionBy()
    lo = F.percentile(F.col("units"), F.lit(q), F.col("k")).over(everything)
    hi = F.percentile(F.col("units"), F.lit(1.0 - q), F.col("k")).over(everything)
    return (F.when(F.col("units") <= lo, F.lit(SLOW))
            .when(F.col("units") >= hi, F.lit(HOT)).otherwise(F.lit(MID)))


def hot_slow_products(t: Roles, q: float = 0.25) -> DataFrame:
    """Classify sold products as slow (units <= p_q), hot (>= p_1-q) or mid.

    Products never sold are left out (they cannot be reviewed).  The cut-offs
    come from the histogram of unit totals as a scalar subquery, so products
    are neither joined nor moved again.  Columns: product_id, units, class.
    """
    if not 0.0 < q < 0.5:
        raise ValueError("q must be in (0, 0.5)")
    units = _product_units(t)
    hist = units.groupBy("units").agg(F.count(F.lit(1)).alias("k"))
    cut = hist.agg(F.struct(F.percentile(F.col("units"), F.lit(q), F.col("k")).alias("lo"),
                            F.percentile(F.col("units"), F.lit(1.0 - q), F.col("k")).alias("hi"))).scalar()
    return units.select(
        "product_id", F.col("units").cast("bigint").alias("units"),
        F.when(F.col("units") <= cut.getField("lo"), F.lit(SLOW))
        .when(F.col("units") >= cut.getField("hi"), F.lit(HOT)).otherwise(F.lit(MID)).alias("class"))


def hot_slow_bad_review_rate(t: Roles, q: float = 0.25, bad_max: int = 2) -> DataFrame:
    """Is the bad-review rate of slow products higher than that of hot ones?

    Unit: a distinct (order, product) pair whose order has a review (score <=
    ``bad_max`` is bad).  A review belongs to the order and is repeated over
    its products, so pairs are not independent and the p-value is optimistic.
    Two-proportion z for rate_slow - rate_hot, one-sided (slow higher).
    Columns: n_slow, bad_slow, rate_slow, n_hot, bad_hot, rate_hot, z, p_one_sided.

    One linear chain, one pass over items: items meet reviews with a left
    join on ``order_id`` (units count for every pair, reviewed or not), pairs
    reduce to products (units, reviewed pairs, bad pairs), products reduce to
    the histogram of unit totals, which carries the cut-offs and the counts.
    """
    if not 0.0 < q < 0.5:
        raise ValueError("q must be in (0, 0.5)")
    pairs = (
        t.item.select("order_id", "product_id", "units")
        .join(order_review(t), "order_id", "left")
        .groupBy("order_id", "product_id")
        .agg(F.sum("units").alias("units"),
             F.max((F.col("score") <= bad_max).cast("int")).alias("bad"))
    )
    per_product = pairs.groupBy("product_id").agg(
        F.sum("units").alias("units"), F.count("bad").alias("n"), F.sum("bad").alias("x"))
    hist = per_product.groupBy("units").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("x").alias("x"))
    scored = hist.select(_class_by_units(hist, q).alias("class"), "n", "x")
    slow, hot = F.col("class") == SLOW, F.col("class") == HOT
    m = scored.agg(
        F.coalesce(F.sum(F.when(slow, F.col("n"))), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.when(slow, F.col("x"))), F.lit(0)).alias("x1"),
        F.coalesce(F.sum(F.when(hot, F.col("n"))), F.lit(0)).alias("n2"),
        F.coalesce(F.sum(F.when(hot, F.col("x"))), F.lit(0)).alias("x2"))
    z = stats.two_proportion(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"), "greater")
    return m.select(
        F.col("n1").cast("bigint").alias("n_slow"), F.col("x1").cast("bigint").alias("bad_slow"),
        F.round(stats.ratio(F.col("x1"), F.col("n1")), 6).alias("rate_slow"),
        F.col("n2").cast("bigint").alias("n_hot"), F.col("x2").cast("bigint").alias("bad_hot"),
        F.round(stats.ratio(F.col("x2"), F.col("n2")), 6).alias("rate_hot"),
        z["z"].alias("z"), z["p_one_sided"].alias("p_one_sided"))
