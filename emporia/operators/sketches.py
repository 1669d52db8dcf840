"""Mergeable sketches by month: distinct buyers and quantiles that are merged on read.

An exact distinct count or percentile over all history has to see all history.
A sketch of a month is a few kilobytes that is written once: any span of months
is then a merge of as many small rows, and the answer carries a stated error:

* distinct buyers: HyperLogLog sketches of 2^12 registers; relative standard
  error 1.04 / 64 = 1.6 %; ``HLL_BOUND`` is four of those;
* quantiles: KLL sketches; with k = 200 the rank of an answer is off by less than
  1.65 % with a confidence of 99 % for a single quantile.

Null buyers are not counted, null amounts are not sketched; a month without
either has null sketches, which merges skip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.operators.customers import _gap_histogram
from emporia.operators.retention import buyer_days
from emporia.plans.bases import order_pay
from emporia.sources.roles import Roles

HLL_BITS, KLL_K = 12, 200
HLL_BOUND, KLL_BOUND = 4 * 1.04 / 64, 0.0165
PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def monthly_sketches(t: Roles) -> DataFrame:
    """month, state, city, orders, buyers (HLL of persons), amounts (KLL of order amounts in cents): one row a month and city.

    Customers meet orders at order grain; the sketches are partial aggregates, so a
    task sends a sketch for each month and city it saw, not its orders.
    """
    cents = (F.col("order_amount") * 100).cast("bigint")
    orders = t.order.select("order_id", "customer_id", F.trunc(F.to_date("purchase_ts"), "month").alias("month")).join(
        order_pay(t).select("order_id", cents.alias("cents")), "order_id", "left")
    rows = orders.join(t.customer.select("customer_id", F.col("person_id").cast("string").alias("person_id"), "state", "city"), "customer_id")
    return rows.groupBy("month", "state", "city").agg(
        F.count(F.lit(1)).alias("orders"), F.hll_sketch_agg("person_id", F.lit(HLL_BITS)).alias("buyers"),
        F.kll_sketch_agg_bigint("cents", F.lit(KLL_K)).alias("amounts"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """``by``, orders, buyers (estimate) and amounts (merged sketch) of the rows of ``monthly_sketches`` with equal ``by``."""
    return sketches.groupBy(*by).agg(
        F.sum("orders").alias("orders"), F.hll_sketch_estimate(F.hll_union_agg("buyers")).alias("buyers"),
        F.kll_merge_agg_bigint("amounts").alias("amounts"))


def city_buyers_sketched(t: Roles) -> DataFrame:
    """M1's distinct buyers of a city, exact and from merged months, and whether the sketch keeps its bound.

    A sketch of few buyers is exact.  Columns: state, city, customers (exact), within_bound.
    """
    sketched = merged(monthly_sketches(t), "state", "city").select("state", "city", "buyers")
    per_customer = t.order.select("customer_id").distinct()
    exact = per_customer.join(t.customer.select("customer_id", "person_id", "state", "city"), "customer_id").select(
        "state", "city", "person_id").distinct().groupBy("state", "city").agg(F.count("person_id").alias("customers"))
    same = F.col("state").eqNullSafe(F.col("s")) & F.col("city").eqNullSafe(F.col("c"))
    both = exact.join(sketched.withColumnsRenamed({"state": "s", "city": "c"}), same)
    return both.select("state", "city", F.col("customers").cast("bigint").alias("customers"),
                       (F.abs(F.col("buyers") - F.col("customers")) <= F.greatest(F.lit(0.5), HLL_BOUND * F.col("customers"))).alias("within_bound"))


def monthly_gap_sketches(t: Roles) -> DataFrame:
    """month, gaps, days: how many orders of a month followed another one of their buyer, and a KLL sketch of the days between."""
    w = Window.partitionBy("person_id").orderBy("day")  # a buyer's distinct purchase days: bounded by the calendar
    gap = F.datediff("day", F.lag("day").over(w)).cast("bigint")
    same_day = F.array_repeat(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("int"))
    rows = buyer_days(t).select(F.trunc("day", "month").alias("month"), F.concat(F.array(gap), same_day).alias("g")).select("month", F.explode("g").alias("gap"))
    return rows.where(F.col("gap").isNotNull()).groupBy("month").agg(
        F.count(F.lit(1)).alias("gaps"), F.kll_sketch_agg_bigint("gap", F.lit(KLL_K)).alias("days"))


def repurchase_gaps_sketched(t: Roles, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """C8's percentiles of the days between orders: exact by rank, and whether merged monthly sketches keep their bound.

    ``exact`` is the smallest gap that at least the share p of all gaps does not
    exceed.  ``within_bound``: the share of gaps below the sketch's answer is at
    most p + KLL_BOUND, and that of gaps up to it at least p - KLL_BOUND.  The
    exact side is the histogram of C8, as long as the calendar at most.
    Columns: p, exact, within_bound.
    """
    hist = _gap_histogram(t)
    everything = Window.partitionBy()
    until = Window.orderBy("gap_days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, upto = F.sum("gaps").over(everything), F.sum("gaps").over(until)
    ranks = hist.select(F.struct(F.col("gap_days").cast("bigint").alias("value"), stats.ratio(upto - F.col("gaps"), total).alias("lo"),
                                 stats.ratio(upto, total).alias("hi")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r")).scalar()
    ps = F.array(*[F.lit(float(p)) for p in percentiles])
    whole = monthly_gap_sketches(t).agg(F.kll_merge_agg_bigint("days").alias("s"), F.sum("gaps").alias("n")).where("n > 0")
    answers = whole.select(F.explode(F.arrays_zip(ps.alias("p"), F.kll_sketch_get_quantile_bigint("s", ps).alias("answer"))).alias("a"))
    rows = answers.select("a.p", "a.answer", ranks.alias("r"))
    first = F.get(F.filter("r", lambda x: x["hi"] >= F.col("p")), F.lit(0))
    at = F.get(F.filter("r", lambda x: x["value"] == F.col("answer")), F.lit(0))
    fits = (at["lo"] - KLL_BOUND <= F.col("p")) & (at["hi"] + KLL_BOUND >= F.col("p"))
    return rows.select("p", first["value"].alias("exact"), F.coalesce(fits, F.lit(False)).alias("within_bound"))
