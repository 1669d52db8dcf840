"""Payments and review feedback (P1-P4), with tests for dependent cells and for concentration beyond chance.

Scale notes: an order's payment methods are collected per order with
``collect_set`` (bounded by the number of payment methods, not by rows), so
payments meet orders at order grain and each method is then counted with a
partial+final aggregation.  Reviews meet items on ``order_id``; the
(order, seller) de-duplication reuses that hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.functions.money import exact_sum, money_of
from emporia.functions.ranking import global_rank
from emporia.plans.bases import UNKNOWN, order_pay, order_review
from emporia.sources.roles import Roles

COMPLETED = "delivered"


def _method_orders(t: Roles) -> DataFrame:
    """payment_type (``unknown`` where it is null), order_id, status: one row per (order, method)."""
    methods = t.payment.select("order_id", F.coalesce("payment_type", F.lit(UNKNOWN)).alias("payment_type")).distinct()
    return methods.join(t.order.select("order_id", "status"), "order_id")


def _completion(t: Roles) -> DataFrame:
    return _method_orders(t).groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("status") == COMPLETED).alias("completed"))


def completion_rate_by_payment(t: Roles) -> DataFrame:
    """Order completion rate (status delivered) by payment method.

    Distinct orders per method; an order paid two ways counts under both.
    Columns: payment_type, orders, completed, completion_rate.
    """
    return _completion(t).select(
        "payment_type", F.col("orders").cast("bigint").alias("orders"),
        F.col("completed").cast("bigint").alias("completed"),
        F.round(stats.ratio(F.col("completed"), F.col("orders")), 6).alias("completion_rate"))


def completion_payment_chi2(t: Roles) -> DataFrame:
    """P1 companion: chi-square test of independence, payment method x completed.

    Computed from the per-method counts (one row per method) with margins as
    windows over those few rows.  dof counts margins that are not empty; with
    a single row or column (all orders completed, say) everything is null.  An
    order paid two ways is in two cells, so cells are not quite independent;
    and payment method is not randomised: association only.  One row:
    statistic, dof, p_value.
    """
    cells = _completion(t).select(
        "payment_type", F.col("completed").cast("double").alias("c"),
        (F.col("orders") - F.col("completed")).cast("double").alias("nc"),
        F.col("orders").cast("double").alias("o"))
    # One row per payment method (a small fixed domain): margins are tiny windows.
    everything = Window.partitionBy()
    with_margins = cells.select(
        "c", "nc", "o", F.sum("o").over(everything).alias("n_all"),
        F.sum("c").over(everything).alias("c_all"), F.count(F.lit(1)).over(everything).alias("rows"))
    n_all, c_all = F.col("n_all"), F.col("c_all")
    e_c = F.col("o") * c_all / n_all
    e_n = F.col("o") * (n_all - c_all) / n_all
    part = (F.when(e_c > 0, F.pow(F.col("c") - e_c, 2) / e_c).otherwise(0.0)
            + F.when(e_n > 0, F.pow(F.col("nc") - e_n, 2) / e_n).otherwise(0.0))
    columns = (F.when(c_all > 0, 1).otherwise(0) + F.when(n_all - c_all > 0, 1).otherwise(0))
    stat = with_margins.select(part.alias("part"), "rows", columns.alias("columns")).agg(
        F.sum("part").alias("x2"), ((F.max("rows") - 1) * (F.max("columns") - 1)).cast("bigint").alias("k"))
    ok = F.col("k") >= 1
    return stat.select(F.round(F.when(ok, F.col("x2")), 6).alias("statistic"), F.when(ok, F.col("k")).alias("dof"),
                       stats.chi2_sf(F.when(ok, F.col("x2")), F.when(ok, F.col("k"))).alias("p_value"))


def completion_payment_rao_scott(t: Roles) -> DataFrame:
    """P1's chi-square for orders paid several ways (Rao-Scott, first order).

    An order that uses m methods lies in m cells at once, so cells are not
    independent.  The statistic is divided by ``design_effect``: the variance of
    the cells' departures from independence over orders, against the variance
    as if every (order, method) were an order of its own (both linearised and
    weighted as in the trace of Rao and Scott's matrix).  With one method an
    order it is 1.  One row: statistic, dof, design_effect, adjusted, p_value.
    """
    done = (F.col("status").eqNullSafe(F.lit(COMPLETED))).cast("int")
    # A handful of rows an order, one per method; m is counted where they already lie together.
    units = _method_orders(t).select("payment_type", done.alias("y"), F.count(F.lit(1)).over(Window.partitionBy("order_id")).alias("m"))
    cells = units.groupBy("payment_type", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("m").cast("double").alias("s"))
    # From here on two rows a method.  The sum of m over units is the sum of m squared over orders.
    y, n, s = F.col("y"), F.col("n"), F.col("s")
    everything, method, side = Window.partitionBy(), Window.partitionBy("payment_type"), Window.partitionBy("y")
    cells = cells.select(
        "payment_type", "y", "n", "s", F.sum(n).over(everything).alias("all"), F.sum(n).over(method).alias("own"), F.sum(n * y).over(method).alias("own_done"),
        F.sum(n * y).over(everything).alias("done"))
    # Both outcomes of every method, also those that did not occur.
    both = cells.groupBy("payment_type").agg(
        *[F.coalesce(F.max(F.when(y == v, F.col(c))), F.lit(0.0)).alias(f"{c}{v}") for c in ("n", "s") for v in (0, 1)],
        *[F.max(c).alias(c) for c in ("all", "own", "own_done", "done")])
    both = both.select("*", *[F.sum(f"{c}{v}").over(everything).alias(f"{c}{v}_all") for c in ("n", "s") for v in (0, 1)])
    p, q = F.col("own") / F.col("all"), F.col("done") / F.col("all")
    h = F.col("own_done") / F.col("all") - p * q

    def spread(clusters):
        total = F.lit(0.0)
        for v in (0, 1):
            a = F.lit(float(v)) - q
            c = p * a + h
            mine, whole = (F.col(f"s{v}"), F.col(f"s{v}_all")) if clusters else (F.col(f"n{v}"), F.col(f"n{v}_all"))
            total = total + F.col(f"n{v}") * a * a - 2.0 * a * c * mine + c * c * whole
        return total / p

    expected = F.col("all") * p * q * (1.0 - q)
    m = both.select(spread(True).alias("orders"), spread(False).alias("units"), F.try_divide(F.pow(F.col("all") * h, F.lit(2.0)), expected).alias("x2"), q.alias("q")).agg(
        F.sum("orders").alias("orders"), F.sum("units").alias("units"), F.sum("x2").alias("x2"), (F.count(F.lit(1)) - 1).alias("k"), F.max("q").alias("q"))
    ok = (F.col("k") >= 1) & (F.col("q") > 0) & (F.col("q") < 1)
    effect = F.when(ok, F.try_divide(F.col("orders"), F.when(F.col("units") > 0, F.col("units"))))
    m = m.select(F.when(ok, F.col("x2")).alias("x2"), F.when(ok, F.col("k")).alias("k"), effect.alias("effect"))
    adjusted = F.try_divide(F.col("x2"), F.when(F.col("effect") > 0, F.col("effect")))
    return m.select(F.round("x2", 6).alias("statistic"), F.col("k").cast("bigint").alias("dof"), F.round("effect", 6).alias("design_effect"),
                    F.round(adjusted, 6).alias("adjusted"), stats.chi2_sf(adjusted, F.col("k")).alias("p_value"))


def avg_order_amount_by_payment(t: Roles) -> DataFrame:
    """Average order amount of orders using each payment method.

    The amount is the whole order's (all its payments), not the slice paid by
    the method; contrast with C5.  Columns: payment_type, orders, avg_order_amount.
    """
    amounts = _method_orders(t).join(order_pay(t).select("order_id", "order_amount"), "order_id")
    agg = amounts.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_amount").alias("amount"))
    return agg.select(
        "payment_type", F.col("orders").cast("bigint").alias("orders"),
        F.round(stats.ratio(F.col("amount"), F.col("orders")), 6).alias("avg_order_amount"))


def installment_avg_payment(t: Roles, min_installments: int = 2) -> DataFrame:
    """Average payment on instalment plans, per plan length plus a total row.

    Only payments with installments >= ``min_installments``.  avg_value is the
    mean payment; avg_installment the mean of value / installments.  The
    rollup adds the all-plans row with installments null.
    Columns: installments, payments, avg_value, avg_installment.
    """
    pays = t.payment.filter(F.col("installments") >= min_installments)
    agg = pays.rollup("installments").agg(
        F.count(F.lit(1)).alias("payments"),
        exact_sum(F.col("value"), money_of(t.payment, "value")).alias("value"),
        F.sum(F.col("value").cast("double") / F.col("installments")).alias("per_inst"))
    return agg.select(
        F.col("installments").cast("bigint").alias("installments"),
        F.col("payments").cast("bigint").alias("payments"),
        F.round(stats.ratio(F.col("value"), F.col("payments")), 6).alias("avg_value"),
        F.round(stats.ratio(F.col("per_inst"), F.col("payments")), 6).alias("avg_installment"))


def _seller_reviews(t: Roles, bad_max: int) -> DataFrame:
    """seller_id, reviews, bad: one review per (order, seller)."""
    pairs = (
        t.item.select("order_id", "seller_id")
        .join(order_review(t), "order_id")
        .groupBy("order_id", "seller_id").agg(F.max("score").alias("score"))
    )
    return pairs.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col("score") <= bad_max).alias("bad"))


def seller_bad_review_concentration(t: Roles, bad_max: int = 2) -> DataFrame:
    """Do bad reviews concentrate on a few sellers?

    Per seller: reviews, bad (score <= ``bad_max``), bad_rate, bad_share (of
    all bad reviews), cum_share (running share by rank), rank (bad desc,
    seller_id) and z (seller's bad rate against the pooled rate).
    Totals are a scalar subquery; rank and running share come from
    :func:`emporia.functions.ranking.global_rank`, so no task holds every
    seller.  Columns: seller_id, reviews, bad, bad_rate, bad_share,
    cum_share, rank, z.
    """
    per = _seller_reviews(t, bad_max)
    ranked = global_rank(per, [F.col("bad").desc(), F.col("seller_id").asc()],
                         rank="rank", running="bad", running_out="cum_bad")
    # Totals from the ranked (checkpointed) table: no second pass over items and reviews.
    totals = ranked.agg(F.struct(F.sum("bad").alias("tb"), F.sum("reviews").alias("tr"))).scalar()
    j = ranked.withColumn("tb", totals.getField("tb")).withColumn("tr", totals.getField("tr"))
    p0 = stats.ratio(F.col("tb"), F.col("tr"))
    return j.select(
        "seller_id",
        F.col("reviews").cast("bigint").alias("reviews"),
        F.col("bad").cast("bigint").alias("bad"),
        F.round(stats.ratio(F.col("bad"), F.col("reviews")), 6).alias("bad_rate"),
        F.round(stats.ratio(F.col("bad"), F.col("tb")), 6).alias("bad_share"),
        F.round(stats.ratio(F.col("cum_bad"), F.col("tb")), 6).alias("cum_share"),
        "rank",
        stats.one_sample_proportion_z(F.col("bad"), F.col("reviews"), p0).alias("z"),
    )


def seller_bad_review_summary(t: Roles, bad_max: int = 2, top_fraction: float = 0.1) -> DataFrame:
    """P4 companion: sellers, bad reviews, top-decile share and HHI.

    top_share is the share of bad reviews held by the ceil(10%) sellers with
    most bad reviews; ties at the cut do not matter because tied sellers
    hold equal counts.  It is computed from a histogram of bad counts (at
    most sqrt(2 x bad reviews) distinct values), so no per-seller ranking is
    needed.  HHI = sum of squared bad shares.  One row: sellers, bad,
    top_sellers, top_share, hhi.
    """
    per = _seller_reviews(t, bad_max)
    hist = per.groupBy("bad").agg(F.count(F.lit(1)).alias("k"))
    # Exact decimal product: in doubles 30 * 0.1 = 3.0000000000000004 would round up.
    frac = F.lit(f"{top_fraction:.6f}").cast("decimal(10,6)")
    # Histogram rows (distinct bad counts) are few, so these windows are tiny.
    top_n = F.ceil(F.sum("k").over(Window.partitionBy()).cast("decimal(20,0)") * frac)
    before = F.coalesce(F.sum("k").over(
        Window.orderBy(F.col("bad").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.least(F.col("k"), F.greatest(F.col("top_n") - before, F.lit(0)))
    out = (
        hist.select("bad", "k", top_n.alias("top_n"))
        .select("bad", "k", "top_n", (take * F.col("bad")).alias("top_part"))
        .agg(F.sum("k").alias("sellers"), F.sum(F.col("bad") * F.col("k")).alias("tb"),
             F.sum(F.col("bad").cast("decimal(38,0)") * F.col("bad") * F.col("k")).alias("sq"),
             F.sum("top_part").alias("top_bad"), F.max("top_n").alias("top_n"))
    )
    return out.select(
        F.col("sellers").cast("bigint").alias("sellers"),
        F.col("tb").cast("bigint").alias("bad"),
        F.col("top_n").cast("bigint").alias("top_sellers"),
        F.round(stats.ratio(F.col("top_bad"), F.col("tb")), 6).alias("top_share"),
        F.round(F.try_divide(F.col("sq").cast("double"),
                             F.pow(F.col("tb").cast("double"), 2)), 6).alias("hhi"))


def _dispersion(per: DataFrame) -> DataFrame:
    """One row of moments over sellers (reviews, bad): sellers, reviews, p, x2 (Pearson) and rho.

    rho is the intra-seller correlation of the beta-binomial model by the method
    of moments, 0 where sellers differ no more than chance: with k sellers,
    E[x2] = (k - 1) (1 - rho) + rho (N - sum n^2 / N).
    """
    n, x = F.col("reviews").cast("double"), F.col("bad").cast("double")
    m = per.agg(F.count(F.lit(1)).alias("sellers"), F.sum("reviews").alias("reviews"), F.sum("bad").alias("bad"),
                F.sum(x * x / n).alias("xx"), F.sum(n * n).alias("nn"))
    total = F.col("reviews").cast("double")
    p = stats.ratio(F.col("bad"), F.col("reviews"))
    m = m.withColumn("p", p)
    # Sum of n (rate - p)^2 over p (1 - p).
    x2 = F.when((F.col("p") > 0) & (F.col("p") < 1), (F.col("xx") - F.col("p") * F.col("bad")) / (F.col("p") * (1.0 - F.col("p"))))
    m = m.withColumn("x2", x2)
    spare = F.col("sellers") - 1.0
    rho = F.try_divide(F.col("x2") - spare, F.when(total - F.col("nn") / total - spare > 0, total - F.col("nn") / total - spare))
    return m.withColumn("rho", F.least(F.greatest(rho, F.lit(0.0)), F.lit(1.0)))


def seller_bad_review_dispersion(t: Roles, bad_max: int = 2) -> DataFrame:
    """Do sellers' bad-review rates differ by more than chance?

    Pearson's statistic against equal rates, its chi-square tail, and the
    intra-seller correlation ``rho`` of a beta-binomial model (0: chance).
    ``prior_reviews`` = 1 / rho - 1 is how many reviews of its own weigh as much
    as what is known of all sellers (null: infinitely many).  One row: sellers,
    reviews, bad_rate, statistic, dof, p_value, rho, prior_reviews.
    """
    m = _dispersion(_seller_reviews(t, bad_max))
    dof = F.when(F.col("x2").isNotNull() & (F.col("sellers") >= 2), F.col("sellers") - 1)
    return m.select(
        "sellers", F.coalesce("reviews", F.lit(0)).cast("bigint").alias("reviews"), F.round("p", 6).alias("bad_rate"),
        F.round(F.when(dof >= 1, F.col("x2")), 6).alias("statistic"), dof.cast("bigint").alias("dof"),
        F.round(F.when(dof >= 1, stats.chi2_tail(F.col("x2"), dof)), stats.P_DIGITS).alias("p_value"), F.round("rho", 9).alias("rho"),
        F.round(F.try_divide(1.0 - F.col("rho"), F.when(F.col("rho") > 0, F.col("rho"))), 4).alias("prior_reviews"))


#: z scores are sorted into steps of 1/Z_STEPS between -Z_SPAN and Z_SPAN, rounded down.
Z_STEPS, Z_SPAN = 100, 12


def seller_bad_review_flags(t: Roles, bad_max: int = 2, level: float = 0.05) -> DataFrame:
    """Which sellers are worse than chance explains?

    ``shrunk_rate`` is the empirical-Bayes rate: the seller's own reviews and
    ``prior_reviews`` reviews of the overall rate (the overall rate itself where
    sellers do not differ).  ``flagged``: the seller's z against the overall rate
    is found by the Benjamini-Hochberg rule at ``level`` over all sellers.  The
    rule needs the number of sellers at every z only: a histogram of at most
    2,400 steps (z rounded down, which errs towards not flagging).  Sellers
    with one review have no z and are never flagged, but count among all.
    Columns: seller_id, reviews, bad, bad_rate, shrunk_rate, z, flagged.
    """
    per = _seller_reviews(t, bad_max)
    known = _dispersion(per).select(F.struct("p", "rho").alias("m")).scalar()
    p, rho = known.getField("p"), known.getField("rho")
    n, x = F.col("reviews").cast("double"), F.col("bad").cast("double")
    z = stats.one_sample_proportion_z(F.col("bad"), F.col("reviews"), p)
    step = F.floor(F.greatest(F.least(z, F.lit(float(Z_SPAN))), F.lit(-float(Z_SPAN))) * Z_STEPS).cast("int")
    scored = per.select("seller_id", "reviews", "bad", p.alias("p"), rho.alias("rho"), z.alias("z"), step.alias("step"))
    hist = scored.groupBy("step").agg(F.count(F.lit(1)).alias("k"))
    down = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = hist.select("step", F.sum("k").over(Window.partitionBy()).alias("all"), F.sum(F.when(F.col("step").isNotNull(), F.col("k")).otherwise(0)).over(down).alias("seen"))
    tail = stats.normal_sf(F.col("step") / float(Z_STEPS))
    cut = found.where(F.col("step").isNotNull() & (tail <= level * F.col("seen") / F.col("all"))).agg(F.min("step").alias("cut")).scalar()
    # Shrinkage by rho without dividing by it: weight of the own rate = n rho / (1 - rho + n rho).
    weight = n * F.col("rho") / (1.0 - F.col("rho") + n * F.col("rho"))
    return scored.select(
        "seller_id", F.col("reviews").cast("bigint").alias("reviews"), F.col("bad").cast("bigint").alias("bad"),
        F.round(x / n, 6).alias("bad_rate"), F.round(F.col("p") + weight * (x / n - F.col("p")), 6).alias("shrunk_rate"), "z",
        F.coalesce(F.col("step") >= cut, F.lit(False)).alias("flagged"))
