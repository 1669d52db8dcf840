"""Order-grain and person-grain bases shared by the analyses.

Rule: payments, items and reviews are each reduced to **order grain** before
they meet, so no join multiplies a sum (an order with two payments and three
items must not count its amount six times).  Bases are lazy; callers that
reuse one many times (``write_marts``) materialize it once.

Shuffle notes (for a cluster):

* each base is one hash aggregation on ``order_id`` with map-side partial
  aggregation, so a hot order cannot overload a reducer;
* person-grain bases aggregate to ``customer_id`` *before* joining the
  customer role, so the customer join runs at customer grain, never at
  order grain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from emporia.functions.dates import add_periods, period_start
from emporia.functions.money import exact_sum, money_of
from emporia.sources.roles import Roles

UNKNOWN = "unknown"


def order_pay(t: Roles) -> DataFrame:
    """order_id, order_amount (exact decimal sum of payments), payments."""
    vs = money_of(t.payment, "value")
    return t.payment.groupBy("order_id").agg(
        exact_sum(F.col("value"), vs).alias("order_amount"), F.count(F.lit(1)).alias("payments"))


def order_item(t: Roles) -> DataFrame:
    """order_id, items, units, sales (exact), freight (exact)."""
    ps, fs = money_of(t.item, "price"), money_of(t.item, "freight")
    return t.item.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("units").alias("units"),
        exact_sum(F.col("price"), ps).alias("sales"),
        exact_sum(F.col("freight"), fs).alias("freight"),
    )


# A review's time and score as one bigint: microseconds (58 bits reach year 9999) above 5 bits of score.
SCORE_ZERO, LEAST_SCORE, LARGEST_SCORE = 16, -15, 15
NO_TIME = -(1 << 58)  # earlier than all times


def order_review(t: Roles) -> DataFrame:
    """One review per order: the latest by review_ts, ties to the higher score.

    Time and score are packed into one bigint, so that ``max`` over it is a
    hash aggregate on a fixed-width buffer (a struct would make Spark sort).  A
    null time is earlier than all others, a null score lower than all others;
    a score outside -15..15 is refused.
    """
    score = F.col("score")
    fine = score.isNull() | score.between(LEAST_SCORE, LARGEST_SCORE)
    code = F.when(fine, F.coalesce(score.cast("bigint") + SCORE_ZERO, F.lit(0).cast("bigint"))).otherwise(
        F.raise_error(F.lit(f"a review score lies outside {LEAST_SCORE}..{LARGEST_SCORE}")).cast("bigint"))
    latest = F.max(F.coalesce(micros(t.review, "review_ts"), F.lit(NO_TIME)) * 32 + code)
    code = F.pmod(latest, F.lit(32).cast("bigint"))
    return t.review.groupBy("order_id").agg(F.when(code > 0, code - SCORE_ZERO).cast("int").alias("score"))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column; of one without time zone as it reads, whatever the session's zone."""
    ts = F.col(name)
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.unix_micros(ts)
    seconds = F.unix_date(F.to_date(ts)).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + F.round(F.expr(f"extract(SECOND FROM {name})").cast("double") * 1e6).cast("bigint")


def with_category(t: Roles, per_product: DataFrame) -> DataFrame:
    """Rows that hold a ``product_id`` (aggregated to it first, so a hot product is one row) with their category."""
    joined = per_product.join(t.product.select("product_id", "category"), "product_id", "left")
    return joined.withColumn("category", F.coalesce(F.col("category"), F.lit(UNKNOWN)))


def latest_periods(t: Roles, grain: str) -> tuple[Column, Column, Column]:
    """Starts of the last but one complete period, the last one and the one after it, as a scalar subquery.

    A period is complete when its last day is not after the latest purchase date.
    """
    bounds = t.order.agg(F.max(F.to_date("purchase_ts")).alias("hi")).select(
        add_periods(period_start(F.date_add(F.col("hi"), 1), grain), -1, grain).alias("cur"))
    b = bounds.select(F.struct(add_periods(F.col("cur"), -1, grain).alias("prev"), "cur",
                               add_periods(F.col("cur"), 1, grain).alias("nxt"))).scalar()
    return b.getField("prev"), b.getField("cur"), b.getField("nxt")


def person_orders(t: Roles) -> DataFrame:
    """person_id, orders: order count per buyer, aggregated at customer grain first."""
    per_customer = t.order.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))
    return (
        per_customer.join(t.customer.select("customer_id", "person_id"), "customer_id")
        .groupBy("person_id").agg(F.sum("orders").alias("orders"))
    )
