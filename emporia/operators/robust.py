"""Companions of the tests whose units are not independent or whose scores are ranks.

* Cluster-robust versions of S6 and M4: units of one order share its review or
  its parcel, so the variance is taken over orders.  The difference of two
  means is a sum of contributions of orders; the sandwich variance is the sum
  of their squares.  With one unit an order it is the plain variance.
* Mann-Whitney versions of C10 and L3: review scores are ordered, not metric.
  Everything follows from a histogram of score by group, so no row is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.operators.logistics import late_flag
from emporia.operators.market import _item_states
from emporia.operators.sales import HOT, SLOW, hot_slow_products
from emporia.plans.bases import order_review
from emporia.sources.roles import Roles


def clustered_difference(clusters: DataFrame, direction: str) -> DataFrame:
    """mean1 - mean2 with plain and cluster-robust standard errors, from per-cluster sums.

    ``clusters``: n1, s1, q1 and n2, s2, q2, the units of a cluster in each group, the
    sum of their values and of the squares.  Variances divide by n (no
    small-sample factor).  One row: clusters, n1, m1, n2, m2, se_plain,
    se_cluster, design_effect (ratio of the variances), z, p_one_sided.
    """
    sums = ["n1", "s1", "q1", "n2", "s2", "q2"]
    d = {c: F.col(c).cast("double") for c in sums}
    pairs = [(a, b) for i, a in enumerate(["s1", "n1", "s2", "n2"]) for b in ["s1", "n1", "s2", "n2"][i:]]
    m = clusters.where((F.col("n1") > 0) | (F.col("n2") > 0)).agg(
        F.count(F.lit(1)).alias("clusters"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.sum(d[a] * d[b]).alias(f"{a}_{b}") for a, b in pairs])
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    m = m.withColumns({"m1": stats.ratio(F.col("s1"), F.when(n1 > 0, n1)), "m2": stats.ratio(F.col("s2"), F.when(n2 > 0, n2))})
    m1, m2 = F.col("m1"), F.col("m2")
    # The contribution of a cluster is (s1 - m1 n1) / N1 - (s2 - m2 n2) / N2; the sum of its square, multiplied out.
    weight = {"s1": 1.0 / n1, "n1": -m1 / n1, "s2": -1.0 / n2, "n2": m2 / n2}
    variance = F.lit(0.0)
    for a, b in pairs:
        variance = variance + (1.0 if a == b else 2.0) * weight[a] * weight[b] * F.col(f"{a}_{b}")
    plain = (F.col("q1") / n1 - m1 * m1) / n1 + (F.col("q2") / n2 - m2 * m2) / n2
    ok = (n1 >= 2) & (n2 >= 2)
    m = m.withColumns({"plain": F.when(ok, F.greatest(plain, F.lit(0.0))), "robust": F.when(ok, F.greatest(variance, F.lit(0.0)))})
    # A name of its own: beside an output named z, lambdas in the tail would read the rounded one.
    m = m.withColumn("raw", F.when(F.col("robust") > 0, (m1 - m2) / F.sqrt("robust")))
    towards = F.col("raw") if direction == "greater" else -F.col("raw")
    return m.select(
        F.col("clusters").cast("bigint").alias("clusters"), F.col("n1").cast("bigint").alias("n1"), F.round("m1", 6).alias("m1"),
        F.col("n2").cast("bigint").alias("n2"), F.round("m2", 6).alias("m2"),
        F.round(F.sqrt("plain"), 9).alias("se_plain"), F.round(F.sqrt("robust"), 9).alias("se_cluster"),
        F.round(F.try_divide(F.col("robust"), F.when(F.col("plain") > 0, F.col("plain"))), 6).alias("design_effect"),
        F.round("raw", 6).alias("z"), F.round(F.when(F.col("raw").isNotNull(), stats.normal_sf(towards)), stats.P_DIGITS).alias("p_one_sided"))


def _named(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.withColumnsRenamed({"n1": f"n_{first}", "m1": f"mean_{first}", "n2": f"n_{second}", "m2": f"mean_{second}"})


def _group_sums(keys: list[str], rows: DataFrame, first: Column, second: Column, value: Column) -> DataFrame:
    """Per-cluster sums of the two groups for ``clustered_difference``."""
    aggs = []
    for i, group in ((1, first), (2, second)):
        own = F.when(group, value)
        aggs += [F.count(own).alias(f"n{i}"), F.coalesce(F.sum(own), F.lit(0)).alias(f"s{i}"), F.coalesce(F.sum(own * own), F.lit(0)).alias(f"q{i}")]
    return rows.groupBy(*keys).agg(*aggs)


def hot_slow_bad_review_clustered(t: Roles, q: float = 0.25, bad_max: int = 2) -> DataFrame:
    """S6 with the variance taken over orders: are slow products reviewed badly more often than hot ones?

    Unit: a distinct (order, product) pair of a reviewed order, as in S6; all
    pairs of an order share its review, so the order is the cluster.  Columns:
    clusters, n_slow, mean_slow (the bad rate), n_hot, mean_hot, se_plain,
    se_cluster, design_effect, z, p_one_sided (slow higher).
    """
    classes = hot_slow_products(t, q).where(F.col("class").isin(HOT, SLOW)).select("product_id", "class")
    pairs = t.item.select("order_id", "product_id").distinct().join(classes, "product_id").groupBy("order_id").agg(
        F.count_if(F.col("class") == SLOW).alias("slow"), F.count_if(F.col("class") == HOT).alias("hot"))
    bad = (F.col("score") <= bad_max).cast("bigint")
    per_order = pairs.join(order_review(t).where(F.col("score").isNotNull()), "order_id")
    # A review is worth the same to all pairs of its order, so sums are counts times 0 or 1.
    sums = per_order.select(*[c.alias(name) for i, n in ((1, F.col("slow")), (2, F.col("hot"))) for name, c in (
        (f"n{i}", n), (f"s{i}", n * bad), (f"q{i}", n * bad))])
    return _named(clustered_difference(sums, "greater"), "slow", "hot")


def cross_state_freight_clustered(t: Roles) -> DataFrame:
    """M4 with the variance taken over orders: is freight per item higher across state lines?

    Unit: the item, as in M4; items of one order travel together, so the order
    is the cluster.  Columns: clusters, n_cross, mean_cross, n_same, mean_same,
    se_plain, se_cluster, design_effect, z, p_one_sided (cross higher).
    """
    sums = _group_sums(["order_id"], _item_states(t), F.col("cross"), ~F.col("cross"), F.col("freight").cast("double"))
    return _named(clustered_difference(sums, "greater"), "cross", "same")


def mann_whitney(hist: DataFrame, direction: str) -> DataFrame:
    """Mann-Whitney test from a histogram (x, k1, k2): counts of two groups at every value.

    U counts the pairs in which group 1 is higher, ties as a half; the variance
    is corrected for ties, p is normal without continuity correction.  One row:
    n1, n2, u, superiority (U / n1 n2), z, p_one_sided.  The histogram is
    bounded by its distinct values, so the window over it is small.
    """
    below = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    k1, k2 = F.col("k1").cast("decimal(19,0)"), F.col("k2").cast("decimal(19,0)")
    lower = F.coalesce(F.sum(k2).over(below), F.lit(0).cast("decimal(29,0)")).cast("decimal(19,0)")
    rows = hist.select("k1", "k2", (2 * k1 * lower + k1 * k2).cast("decimal(38,0)").alias("twice"), (F.col("k1") + F.col("k2")).cast("double").alias("t"))
    m = rows.agg(F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.sum("twice").alias("twice"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n1, n2, u = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("twice").cast("double") / 2.0
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1.0) - F.col("ties") / (n * (n - 1.0)))
    ok = (n1 >= 2) & (n2 >= 2)
    m = m.withColumn("raw", F.when(ok, F.try_divide(u - n1 * n2 / 2.0, F.when(variance > 0, F.sqrt(variance)))))
    towards = F.col("raw") if direction == "greater" else -F.col("raw")
    return m.select(
        F.coalesce("n1", F.lit(0)).cast("bigint").alias("n1"), F.coalesce("n2", F.lit(0)).cast("bigint").alias("n2"), u.alias("u"),
        F.round(F.try_divide(u, F.when(n1 * n2 > 0, n1 * n2)), 6).alias("superiority"), F.round("raw", 6).alias("z"),
        F.round(F.when(F.col("raw").isNotNull(), stats.normal_sf(towards)), stats.P_DIGITS).alias("p_one_sided"))


def repeat_vs_single_rank(t: Roles) -> DataFrame:
    """C10 by ranks: do repeat buyers score higher than single-order buyers?

    Unit: the buyer with a review, valued by the mean of their reviews to three
    decimals (so the histogram has at most 1,000 values a point of the scale).
    Columns: n_repeat, n_single, u, superiority, z, p_one_sided (repeat higher).
    """
    op = t.order.select("order_id", "customer_id").join(t.customer.select("customer_id", "person_id"), "customer_id")
    people = op.join(order_review(t), "order_id", "left").groupBy("person_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("score").alias("s"), F.count("score").alias("k")).where("k > 0")
    x = F.floor((F.col("s") * 2000 + F.col("k")) / (2 * F.col("k")))  # thousandths, rounded half up, from whole numbers
    hist = people.groupBy(x.alias("x")).agg(F.count_if(F.col("orders") >= 2).alias("k1"), F.count_if(F.col("orders") < 2).alias("k2"))
    return mann_whitney(hist, "greater").withColumnsRenamed({"n1": "n_repeat", "n2": "n_single"})


def late_vs_ontime_rank(t: Roles) -> DataFrame:
    """L3 by ranks: do late orders get lower review scores?

    Unit: a reviewed order whose lateness is known.  Columns: n_late, n_ontime,
    u, superiority (chance that a late order scores higher, ties a half), z,
    p_one_sided (late lower).
    """
    orders = t.order.select("order_id", late_flag(F.col("delivered_ts"), F.col("promised_ts")).alias("late")).where(F.col("late").isNotNull())
    hist = orders.join(order_review(t), "order_id").where(F.col("score").isNotNull()).groupBy(F.col("score").alias("x")).agg(
        F.count_if(F.col("late")).alias("k1"), F.count_if(~F.col("late")).alias("k2"))
    return mann_whitney(hist, "less").withColumnsRenamed({"n1": "n_late", "n2": "n_ontime"})
