"""Customer behaviour: high-value customers and repeat buying.

Scale notes common to this module:

* Top-k is ``orderBy(...).limit(k)``, which plans as TakeOrderedAndProject:
  each task keeps its own k best rows, so only k x tasks rows ever meet.
* Top-k persons, their customer ids and their orders join without a hint, so
  AQE picks broadcast or sort-merge from the measured runtime size, whatever
  k the caller gives.
* Repeat-buying analyses never window over a person's orders: a single buyer
  may hold a third of all orders.  They aggregate (partial + final) instead,
  and the only per-person window (C8) runs over distinct purchase *days*,
  whose number is bounded by the calendar span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.functions.dates import period_spine
from emporia.functions.money import exact_sum, money_of
from emporia.plans.bases import UNKNOWN, order_pay, order_review, person_orders, with_category
from emporia.sources.roles import Roles


def _person_amounts(t: Roles) -> DataFrame:
    """person_id, order_amount (exact decimal), orders; customer grain first."""
    per_customer = (
        t.order.select("order_id", "customer_id")
        .join(order_pay(t), "order_id", "left")
        .groupBy("customer_id")
        .agg(F.sum("order_amount").alias("order_amount"), F.count(F.lit(1)).alias("orders"))
    )
    return (
        per_customer.join(t.customer.select("customer_id", "person_id"), "customer_id")
        .groupBy("person_id")
        .agg(F.sum("order_amount").alias("order_amount"), F.sum("orders").alias("orders"))
    )


def _top_persons(t: Roles, k: int) -> DataFrame:
    """The k persons with the highest order amount (ties: person_id ascending)."""
    return _person_amounts(t).orderBy(
        F.col("order_amount").desc_nulls_last(), F.col("person_id").asc()).limit(k)


def _top_orders(t: Roles, k: int) -> DataFrame:
    """order_id, person_id of every order placed by a top-k person."""
    top = _top_persons(t, k).select("person_id")
    ids = t.customer.select("customer_id", "person_id").join(top, "person_id", "left_semi")
    return t.order.select("order_id", "customer_id").join(ids, "customer_id").drop("customer_id")


def top_customers(t: Roles, k: int = 100) -> DataFrame:
    """Top k persons by total order amount (sum of payments).

    Columns: person_id, order_amount, orders, rank.  Exactly min(k, persons) rows.
    """
    w = Window.orderBy(F.col("order_amount").desc_nulls_last(), F.col("person_id"))
    return _top_persons(t, k).select(
        "person_id",
        F.col("order_amount").cast("double").alias("order_amount"),
        F.col("orders").cast("bigint").alias("orders"),
        F.row_number().over(w).cast("bigint").alias("rank"),
    )


def top_customer_geo(t: Roles, k: int = 100) -> DataFrame:
    """Where the top k customers live.

    A person with several addresses takes the one on the latest order.
    Columns: state, city, customers, order_amount, customer_share.
    """
    top = _top_persons(t, k)
    ids = t.customer.join(top.select("person_id"), "person_id", "left_semi")
    # Orders of at most k people: the struct buffer's sort is small.
    latest = F.max_by(F.struct("state", "city"), F.struct("purchase_ts", "order_id"))
    address = (
        t.order.select("order_id", "customer_id", "purchase_ts")
        .join(ids.select("customer_id", "person_id", "state", "city"), "customer_id")
        .groupBy("person_id")
        .agg(latest.alias("addr"))
    )
    by_place = (
        top.join(address, "person_id")
        .groupBy(F.col("addr.state").alias("state"), F.col("addr.city").alias("city"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("order_amount").alias("order_amount"))
    )
    # At most k rows (one per place of a top customer): a tiny window.
    total = F.sum("customers").over(Window.partitionBy())
    return by_place.select(
        "state", "city",
        F.col("customers").cast("bigint").alias("customers"),
        F.col("order_amount").cast("double").alias("order_amount"),
        F.round(stats.ratio(F.col("customers"), total), 6).alias("customer_share"),
    )


def top_customer_categories(t: Roles, k: int = 100) -> DataFrame:
    """Categories the top k customers buy, ranked by units then category.

    Columns: category, customers, units, sales, rank.
    """
    # Items meet the product role as (product, person) sums; distinct buyers per
    # category come from the (category, person) aggregate above them.
    per_product = t.item.join(_top_orders(t, k), "order_id").groupBy("product_id", "person_id").agg(
        F.sum("units").alias("units"), exact_sum(F.col("price"), money_of(t.item, "price")).alias("sales"))
    per_person = with_category(t, per_product).groupBy("category", "person_id").agg(
        F.sum("units").alias("units"), F.sum("sales").alias("sales"))
    agg = per_person.groupBy("category").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("units").alias("units"),
        F.sum("sales").alias("sales"),
    )
    # One row per category: a small window whatever the data size.
    w = Window.orderBy(F.col("units").desc(), F.col("category"))
    return agg.select(
        "category",
        F.col("customers").cast("bigint").alias("customers"),
        F.col("units").cast("bigint").alias("units"),
        F.col("sales").cast("double").alias("sales"),
        F.row_number().over(w).cast("bigint").alias("rank"),
    )


PROFILE_FEATURES = (("desc_len", "avg_desc_len"), ("photo_cnt", "avg_photos"),
                    ("name_len", "avg_name_len"), ("weight_g", "avg_weight"))


def top_customer_category_profile(t: Roles, k: int = 100, n: int = 20,
                                  weight: str = "unit") -> DataFrame:
    """C4: the top k customers' n most-bought categories with product features.

    ``weight="unit"`` (default) averages each feature over sold units, skipping
    unknown values; ``weight="product"`` averages over distinct products sold.
    Null when no value is known.  Columns: category, units, avg_desc_len,
    avg_photos, avg_name_len, avg_weight.
    """
    if weight not in ("unit", "product"):
        raise ValueError("weight must be 'unit' or 'product'")
    feats = [f for f, _ in PROFILE_FEATURES]
    per_product = t.item.join(_top_orders(t, k), "order_id", "left_semi").groupBy("product_id").agg(F.sum("units").alias("units"))
    known = t.product.select("product_id", *[f for f in feats if f != "desc_len"]).join(
        t.description.select("product_id", "desc_len"), "product_id", "left")
    items = with_category(t, per_product).join(known, "product_id", "left")
    if weight == "unit":
        aggs = [
            stats.ratio(F.sum(F.col("units") * F.col(f)),
                        F.sum(F.when(F.col(f).isNotNull(), F.col("units")))).alias(out)
            for f, out in PROFILE_FEATURES
        ]
        agg = items.groupBy("category").agg(F.sum("units").alias("units"), *aggs)
    else:
        agg = items.groupBy("category").agg(
            F.sum("units").alias("units"),
            *[F.avg(F.col(f).cast("double")).alias(out) for f, out in PROFILE_FEATURES])
    top = agg.orderBy(F.col("units").desc(), F.col("category")).limit(n)
    return top.select(
        "category", F.col("units").cast("bigint").alias("units"),
        *[F.round(F.col(out), 6).alias(out) for _, out in PROFILE_FEATURES])


def top_customer_payment_aov(t: Roles, k: int = 100) -> DataFrame:
    """Payment methods of the top k customers and average order value.

    aov = payment value by that method / distinct orders using it.  An order
    paid two ways counts under both, but once in the overall row, whose
    payment_type is null (an unknown method is ``unknown``).  Columns:
    payment_type, orders, payment_value, aov.
    """
    pays = (
        t.payment.select("order_id", F.coalesce("payment_type", F.lit(UNKNOWN)).alias("payment_type"), "value")
        .join(_top_orders(t, k).select("order_id"), "order_id", "left_semi")
        .groupBy("order_id", "payment_type")
        .agg(exact_sum(F.col("value"), money_of(t.payment, "value")).alias("value"))
    )
    agg = pays.rollup("payment_type").agg(
        F.count_distinct("order_id").alias("orders"), F.sum("value").alias("payment_value"))
    return agg.select(
        "payment_type",
        F.col("orders").cast("bigint").alias("orders"),
        F.col("payment_value").cast("double").alias("payment_value"),
        F.round(stats.ratio(F.col("payment_value"), F.col("orders")), 6).alias("aov"),
    )


def user_growth(t: Roles) -> DataFrame:
    """New users per month (month of first order) and the running total.

    Months without new users are present with 0.  Columns: month, new_users,
    cumulative_users.
    """
    per_customer = t.order.groupBy("customer_id").agg(F.min("purchase_ts").alias("first_ts"))
    first = (
        per_customer.join(t.customer.select("customer_id", "person_id"), "customer_id")
        .groupBy("person_id").agg(F.min("first_ts").alias("first_ts"))
        .select(F.trunc(F.to_date("first_ts"), "month").alias("month"))
    )
    counts = first.groupBy("month").agg(F.count(F.lit(1)).alias("new_users"))
    bounds = counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = period_spine(bounds, "lo", "hi", "month", name="month")
    filled = spine.join(counts, "month", "left").select(
        "month", F.coalesce(F.col("new_users"), F.lit(0)).cast("bigint").alias("new_users"))
    # One row per calendar month: this window is tiny whatever the data size.
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return filled.select("month", "new_users",
                         F.sum("new_users").over(w).cast("bigint").alias("cumulative_users"))


def repeat_rate(t: Roles, min_orders: int = 2) -> DataFrame:
    """Share of buyers with at least ``min_orders`` orders.

    Denominator: persons with at least one order.  One row: customers,
    repeat_customers, repeat_rate (null for no customers).
    """
    per = person_orders(t)
    agg = per.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("orders") >= min_orders).alias("repeat_customers"))
    return agg.select(
        F.col("customers").cast("bigint").alias("customers"),
        F.col("repeat_customers").cast("bigint").alias("repeat_customers"),
        F.round(stats.ratio(F.col("repeat_customers"), F.col("customers")), 6).alias("repeat_rate"),
    )


# Gap buckets in days (label, lower bound, upper bound inclusive).
GAP_BUCKETS = (("0", 0, 0), ("1-7", 1, 7), ("8-30", 8, 30), ("31-90", 31, 90),
               ("91-180", 91, 180), ("181-365", 181, 365), ("366+", 366, None))


def _gap_histogram(t: Roles) -> DataFrame:
    """gap_days, gaps: days between a buyer's consecutive orders, as a histogram.

    Orders are reduced to (person, purchase day) first.  Several orders on one
    day give day-count - 1 gaps of 0; consecutive purchase days give one gap
    each.  The window then runs over a person's distinct purchase days, which
    the calendar bounds, so even a buyer with a third of all orders is cheap.
    """
    per_customer_day = (
        t.order.select("customer_id", F.to_date("purchase_ts").alias("day"))
        .groupBy("customer_id", "day").agg(F.count(F.lit(1)).alias("n"))
    )
    days = (
        per_customer_day.join(t.customer.select("customer_id", "person_id"), "customer_id")
        .groupBy("person_id", "day").agg(F.sum("n").alias("n"))
    )
    w = Window.partitionBy("person_id").orderBy("day")
    gaps = days.select(
        F.datediff(F.col("day"), F.lag("day").over(w)).alias("gap_days"),
        (F.col("n") - 1).alias("same_day"))
    return gaps.select(
        F.explode(F.array(
            F.struct(F.col("gap_days").alias("gap_days"), F.lit(1).cast("bigint").alias("gaps")),
            F.struct(F.lit(0).alias("gap_days"), F.col("same_day").cast("bigint").alias("gaps")),
        )).alias("g")
    ).select("g.*").filter(F.col("gap_days").isNotNull() & (F.col("gaps") > 0)) \
        .groupBy("gap_days").agg(F.sum("gaps").alias("gaps"))


def repurchase_gaps(t: Roles) -> DataFrame:
    """Distribution of days between consecutive orders of the same buyer.

    Columns: bucket, bucket_lo, gaps, share.  All buckets are present.
    """
    hist = _gap_histogram(t)
    label = None
    for name, lo, hi in GAP_BUCKETS:
        cond = F.col("gap_days") >= lo if hi is None else F.col("gap_days").between(lo, hi)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    per_bucket = hist.groupBy(label.alias("bucket")).agg(F.sum("gaps").alias("gaps"))
    spark = hist.sparkSession
    buckets = spark.createDataFrame([(name, lo) for name, lo, _ in GAP_BUCKETS],
                                    "bucket string, bucket_lo bigint")
    filled = F.broadcast(buckets).join(per_bucket, "bucket", "left").select(
        "bucket", "bucket_lo", F.coalesce(F.col("gaps"), F.lit(0)).cast("bigint").alias("gaps"))
    total = F.sum("gaps").over(Window.partitionBy())  # seven bucket rows
    return filled.select("bucket", "bucket_lo", "gaps",
                         F.round(stats.ratio(F.col("gaps"), total), 6).alias("share"))


def repurchase_gap_summary(t: Roles) -> DataFrame:
    """C8 companion: gaps, avg_days, p50, p90 (exact, linear interpolation).

    Percentiles are computed from the (gap_days, gaps) histogram with
    ``percentile(value, p, frequency)``: the state is one entry per distinct
    gap length, bounded by the calendar span.
    """
    hist = _gap_histogram(t)
    agg = hist.agg(
        F.sum("gaps").alias("gaps"),
        F.sum(F.col("gap_days") * F.col("gaps")).alias("gap_sum"),
        F.percentile(F.col("gap_days"), F.lit(0.5), F.col("gaps")).alias("p50"),
        F.percentile(F.col("gap_days"), F.lit(0.9), F.col("gaps")).alias("p90"),
    )
    return agg.select(
        F.coalesce(F.col("gaps"), F.lit(0)).cast("bigint").alias("gaps"),
        F.round(stats.ratio(F.col("gap_sum"), F.col("gaps")), 6).alias("avg_days"),
        F.round(F.col("p50"), 6).alias("p50"),
        F.round(F.col("p90"), 6).alias("p90"),
    )


def _repeat_order_flags(t: Roles) -> DataFrame:
    """order_id, is_first for orders of repeat buyers (>= 2 orders).

    The first order is the earliest by (purchase_ts, order_id), orders without
    a time before all others.  Every step is a hash aggregate or a join that no
    buyer makes hot: counts and first times per buyer; orders of that time by
    (buyer, time), of which the smallest id is the first; and all orders with
    the first ones on ``order_id``.  An order that is nobody's first one
    belongs to a repeat buyer, and a first one does if its buyer has others.
    """
    kind = t.order.schema["purchase_ts"].dataType
    earliest = F.lit("0001-01-01 00:00:00").cast(kind)
    op = t.order.select("order_id", "customer_id", F.coalesce("purchase_ts", earliest).alias("at")).join(
        t.customer.select("customer_id", "person_id"), "customer_id")
    per_person = op.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_orders"), F.min("at").alias("at"))
    firsts = op.join(per_person, ["person_id", "at"]).groupBy("person_id", "n_orders").agg(
        F.min("order_id").alias("order_id")).select("order_id", "n_orders")
    flags = op.select("order_id").join(firsts, "order_id", "left")
    return flags.where(F.col("n_orders").isNull() | (F.col("n_orders") >= 2)).select(
        "order_id", F.col("n_orders").isNotNull().alias("is_first"))


def first_vs_repeat_categories(t: Roles, n: int = 20) -> DataFrame:
    """Categories in repeat buyers' later orders against their first orders.

    Population: repeat buyers only, so both sides are the same people.  Shares
    are over all categories; lift = repeat_share / first_share (null when
    first_share is 0).  Keeps the n categories with most repeat units.
    Columns: category, first_units, repeat_units, first_share, repeat_share,
    lift, repeat_rank.
    """
    per_product = t.item.join(_repeat_order_flags(t), "order_id").groupBy("product_id").agg(
        F.sum(F.when(F.col("is_first"), F.col("units")).otherwise(0)).alias("first_units"),
        F.sum(F.when(~F.col("is_first"), F.col("units")).otherwise(0)).alias("repeat_units"))
    agg = with_category(t, per_product).groupBy("category").agg(
        F.sum("first_units").alias("first_units"), F.sum("repeat_units").alias("repeat_units"))
    totals = agg.agg(F.struct(F.sum("first_units").alias("tf"),
                              F.sum("repeat_units").alias("tr"))).scalar()
    first_share = stats.ratio(F.col("first_units"), totals.getField("tf"))
    repeat_share = stats.ratio(F.col("repeat_units"), totals.getField("tr"))
    shares = agg.select(
        "category", "first_units", "repeat_units", first_share.alias("fs"), repeat_share.alias("rs"))
    top = shares.orderBy(F.col("repeat_units").desc(), F.col("category")).limit(n)
    w = Window.orderBy(F.col("repeat_units").desc(), F.col("category"))
    return top.select(
        "category",
        F.col("first_units").cast("bigint").alias("first_units"),
        F.col("repeat_units").cast("bigint").alias("repeat_units"),
        F.round("fs", 6).alias("first_share"),
        F.round("rs", 6).alias("repeat_share"),
        F.round(F.try_divide(F.col("rs"), F.when(F.col("fs") != 0, F.col("fs"))), 6).alias("lift"),
        F.row_number().over(w).cast("bigint").alias("repeat_rank"),
    )


def repeat_vs_single_score(t: Roles) -> DataFrame:
    """Do repeat buyers score higher than single-order buyers? (Welch t)

    Unit: the buyer, scored by the mean of their reviewed orders; buyers with
    no review are left out.  Direction: repeat higher.  One row: n_repeat,
    mean_repeat, n_single, mean_single, t, df, p_one_sided.
    """
    op = t.order.select("order_id", "customer_id").join(
        t.customer.select("customer_id", "person_id"), "customer_id")
    per_person = (
        op.join(order_review(t), "order_id", "left")
        .groupBy("person_id")
        .agg(F.count(F.lit(1)).alias("n_orders"),
             F.sum("score").alias("score_sum"), F.count("score").alias("reviews"))
        .filter(F.col("reviews") > 0)
        .select((F.col("n_orders") >= 2).alias("rep"),
                (F.col("score_sum") / F.col("reviews")).alias("x"))
    )
    rep, single = F.col("rep"), ~F.col("rep")
    m = per_person.agg(
        F.count_if(rep).alias("n1"), F.avg(F.when(rep, F.col("x"))).alias("m1"),
        F.var_samp(F.when(rep, F.col("x"))).alias("v1"),
        F.count_if(single).alias("n2"), F.avg(F.when(single, F.col("x"))).alias("m2"),
        F.var_samp(F.when(single, F.col("x"))).alias("v2"))
    w = stats.welch(F.col("n1"), F.col("m1"), F.col("v1"), F.col("n2"), F.col("m2"), F.col("v2"),
                    "greater")
    return m.select(
        F.col("n1").cast("bigint").alias("n_repeat"), F.round("m1", 6).alias("mean_repeat"),
        F.col("n2").cast("bigint").alias("n_single"), F.round("m2", 6).alias("mean_single"),
        w["t"].alias("t"), w["df"].alias("df"), w["p_one_sided"].alias("p_one_sided"))
