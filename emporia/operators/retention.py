"""Retention of buyers: cohorts by month and time to the next order with censoring.

Scale notes: orders are reduced to distinct (buyer, month) or (buyer, day)
rows first, customer grain before buyer grain; windows run over a buyer's
distinct months or days, which the calendar bounds, so a buyer with a third
of all orders is cheap.  Everything after that is a histogram by month or day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.sources.roles import Roles


def buyer_days(t: Roles) -> DataFrame:
    """person_id, day, n: orders of a buyer on a day."""
    per_customer = t.order.where(F.col("purchase_ts").isNotNull()).groupBy("customer_id", F.to_date("purchase_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    return per_customer.join(t.customer.select("customer_id", "person_id"), "customer_id").groupBy("person_id", "day").agg(F.sum("n").alias("n"))


def cohort_retention(t: Roles) -> DataFrame:
    """C6/C7 as a triangle: of the buyers whose first order fell in a month, how many ordered so many months later?

    One row for every cohort and every offset up to the last month of the data
    (0 buyers where nobody ordered).  ``retention`` = buyers / cohort_size.
    ``complete``: the month lies wholly before the last purchase day's end, so
    the cell will not grow.  Row 0 of all cohorts adds up to all buyers.
    Columns: cohort, month_offset, buyers, cohort_size, retention, complete.
    """
    per_customer = t.order.where(F.col("purchase_ts").isNotNull()).groupBy(
        "customer_id", F.trunc(F.to_date("purchase_ts"), "month").alias("month")).agg(F.max(F.to_date("purchase_ts")).alias("last"))
    months = per_customer.join(t.customer.select("customer_id", "person_id"), "customer_id").groupBy("person_id", "month").agg(F.max("last").alias("last"))
    marked = months.select("month", "last", F.min("month").over(Window.partitionBy("person_id")).alias("cohort"))
    cells = marked.groupBy("cohort", "month").agg(F.count(F.lit(1)).alias("buyers"), F.max("last").alias("last"))
    # From here on one row per pair of calendar months.
    offset = (F.year("month") - F.year("cohort")) * 12 + F.month("month") - F.month("cohort")
    cells = cells.select("cohort", offset.alias("month_offset"), "buyers", F.max("last").over(Window.partitionBy()).alias("hi"))
    sizes = cells.where("month_offset = 0").select("cohort", F.col("buyers").alias("cohort_size"), "hi")
    span = (F.year("hi") - F.year("cohort")) * 12 + F.month("hi") - F.month("cohort")
    grid = sizes.select("cohort", "cohort_size", "hi", F.explode(F.sequence(F.lit(0), span)).alias("month_offset"))
    filled = grid.join(cells.select("cohort", "month_offset", "buyers"), ["cohort", "month_offset"], "left")
    end = F.date_sub(F.add_months("cohort", F.col("month_offset") + 1), 1)
    return filled.select(
        "cohort", F.col("month_offset").cast("bigint").alias("month_offset"), F.coalesce("buyers", F.lit(0)).cast("bigint").alias("buyers"),
        F.col("cohort_size").cast("bigint").alias("cohort_size"),
        F.round(stats.ratio(F.coalesce("buyers", F.lit(0)), F.col("cohort_size")), 6).alias("retention"),
        (end <= F.col("hi")).alias("complete"))


def _spells(t: Roles) -> DataFrame:
    """days, events, censored: a histogram of the time from every order to the buyer's next one, or to the last purchase day of all."""
    days = buyer_days(t).withColumn("hi", _days_end(t))
    w = Window.partitionBy("person_id").orderBy("day")
    following = F.lead("day").over(w)
    spells = days.select(
        F.datediff(F.coalesce(following, F.col("hi")), "day").alias("days"), following.isNotNull().cast("bigint").alias("events"),
        following.isNull().cast("bigint").alias("censored"), (F.col("n") - 1).alias("same_day"))
    rows = F.array(F.struct("days", "events", "censored"),
                   F.struct(F.lit(0).alias("days"), F.col("same_day").alias("events"), F.lit(0).cast("bigint").alias("censored")))
    return spells.select(F.explode(rows).alias("r")).select("r.*").where("events + censored > 0").groupBy("days").agg(
        F.sum("events").alias("events"), F.sum("censored").alias("censored"))


def _days_end(t: Roles):
    return t.order.agg(F.max(F.to_date("purchase_ts"))).scalar()


def _curve(t: Roles) -> DataFrame:
    """days, at_risk, events, censored, survival, variance (Greenwood's sum): one row per length with an event."""
    hist = _spells(t)  # as many rows as days in the calendar span, at most
    later = Window.orderBy("days").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    until = Window.orderBy("days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = hist.select("days", "events", "censored", F.sum(F.col("events") + F.col("censored")).over(later).alias("at_risk"))
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    ended = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(until) == 1  # nobody is left
    logs = F.sum(F.when(F.col("events") < F.col("at_risk"), F.log1p(-d / n)).otherwise(0.0)).over(until)
    green = F.sum(F.when(F.col("events") < F.col("at_risk"), d / (n * (n - d))).otherwise(0.0)).over(until)
    return risk.select("days", "at_risk", "events", "censored", F.when(ended, 0.0).otherwise(F.exp(logs)).alias("survival"),
                       F.when(ended, F.lit(None).cast("double")).otherwise(green).alias("green"))


def repurchase_survival(t: Roles) -> DataFrame:
    """C8 with censoring: the share of orders not yet followed by the same buyer's next one, by days since (Kaplan-Meier).

    Every order opens a spell that ends with the buyer's next order; the last
    order of a buyer is censored at the last purchase day of the data, so buyers
    who have not bought again yet count while they are observed (C8 looks at
    finished gaps only, and is short for that).  Several orders on one day are
    spells of 0 days.  One row per length with an event: days, at_risk, events,
    survival, std_error (Greenwood; null once nobody is left).
    """
    c = _curve(t).where("events > 0")
    return c.select(
        F.col("days").cast("bigint").alias("days"), F.col("at_risk").cast("bigint").alias("at_risk"), F.col("events").cast("bigint").alias("events"),
        F.round("survival", 6).alias("survival"), F.round(F.col("survival") * F.sqrt("green"), 6).alias("std_error"))


def repurchase_survival_summary(t: Roles, marks: tuple[int, ...] = (30, 90, 180, 365)) -> DataFrame:
    """C8 companion: spells, events, median days to the next order, and the share that ordered again within ``marks`` days.

    The median is the smallest length with survival at most one half (null if
    there is none); a share is null beyond the longest observed spell.
    """
    c = _curve(t)
    ordered = [F.coalesce(1.0 - F.min(F.when(F.col("days") <= d, F.col("survival"))), F.lit(0.0)) for d in marks]
    longest = F.max("days")
    m = c.agg(F.sum(F.col("events") + F.col("censored")).alias("spells"), F.sum("events").alias("events"),
              F.min(F.when(F.round("survival", 12) <= 0.5, F.col("days"))).alias("median"),
              *[F.when(longest >= d, s).alias(f"within_{d}") for d, s in zip(marks, ordered)])
    return m.select(
        F.coalesce("spells", F.lit(0)).cast("bigint").alias("spells"), F.coalesce("events", F.lit(0)).cast("bigint").alias("events"),
        F.col("median").cast("bigint").alias("median_days"), *[F.round(f"within_{d}", 6).alias(f"within_{d}") for d in marks])
