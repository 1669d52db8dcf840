"""An order-grain mart that is refreshed by month (X4, incremental).

``order_mart`` reduces payments, items and reviews to one row an order, with the
buyer's place.  ``OrderMart`` keeps those rows below a folder, one partition a
month of purchase:

    refresh-000001/month=2020-01-01/...   rows, written once and never changed
    refresh-000002/month=2020-02-01/...
    manifest-000002.json                  which refresh holds each month

A refresh computes and writes the months it is given only (``touched`` finds
them), into a folder of its own, and is published by one manifest that is
renamed into place: readers see the months of the manifest they opened, whole,
whatever happens to a running or failed refresh.  ``vacuum`` deletes what the
last manifest does not name.  ``roles`` binds the mart back to roles, so the
analyses in ``ORDER_GRAIN`` run on it unchanged, without the scans and joins of
the base tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.operators.logistics import late_flag
from emporia.plans.bases import order_item, order_pay, order_review
from emporia.sources.roles import Roles

#: The month of orders without a purchase time.
NO_MONTH = "0001-01-01"

#: Analyses that need no more than one row an order.
ORDER_GRAIN = (
    "top_customers", "top_customer_geo", "user_growth", "repeat_rate", "repurchase_gaps", "repurchase_gap_summary", "repurchase_survival",
    "repurchase_survival_summary", "cohort_retention", "repeat_vs_single_score", "repeat_vs_single_rank", "sales_growth", "sales_seasonality",
    "sales_decomposition", "late_vs_ontime_score", "late_vs_ontime_rank", "late_orders_by_city", "city_penetration",
    "low_penetration_high_potential")


def month_of(ts: Column) -> Column:
    return F.coalesce(F.trunc(F.to_date(ts), "month"), F.lit(NO_MONTH).cast("date"))


def order_mart(t: Roles) -> DataFrame:
    """One row an order: the order role, its buyer, exact sums of payments and items, the review's score, and the month."""
    buyers = t.customer.select("customer_id", "person_id", "city", "state", "geo_key")
    # Everything meets on order_id at order grain; the customer join comes last.
    facts = (t.order.select("order_id", "customer_id", "status", "purchase_ts", "delivered_ts", "promised_ts")
             .join(order_pay(t), "order_id", "left").join(order_item(t), "order_id", "left")
             .join(order_review(t).withColumn("reviewed", F.lit(True)), "order_id", "left"))
    return facts.join(buyers, "customer_id", "left").withColumn("purchase_month", month_of(F.col("purchase_ts")))


def order_mart_months(t: Roles) -> DataFrame:
    """The mart by month: orders, order amount, sales, freight, reviews, late deliveries.

    Columns: month (null for orders without a time), orders, order_amount, sales, freight, reviewed,
    avg_score, delivered, late.
    """
    late = late_flag(F.col("delivered_ts"), F.col("promised_ts"))
    per = order_mart(t).select("purchase_month", "order_amount", "sales", "freight", "reviewed", "score", late.alias("late")).groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_amount").alias("order_amount"), F.sum("sales").alias("sales"), F.sum("freight").alias("freight"),
        F.count("reviewed").alias("reviewed"), F.sum("score").alias("score"), F.count("score").alias("scored"),
        F.count("late").alias("delivered"), F.count_if("late").alias("late"))
    return per.select(
        F.when(F.col("purchase_month") != F.lit(NO_MONTH).cast("date"), F.col("purchase_month")).alias("month"), F.col("orders").cast("bigint").alias("orders"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("order_amount", "sales", "freight")],
        F.col("reviewed").cast("bigint").alias("reviewed"), F.round(stats.ratio(F.col("score"), F.when(F.col("scored") > 0, F.col("scored"))), 6).alias("avg_score"),
        F.col("delivered").cast("bigint").alias("delivered"), F.col("late").cast("bigint").alias("late"))


def touched(t: Roles, since) -> list[str]:
    """Months of the orders that were placed, delivered or reviewed at ``since`` or later (the calendar bounds their number)."""
    def later(role: DataFrame, name: str) -> Column:
        return F.col(name) >= F.lit(since).cast(role.schema[name].dataType)

    own = t.order.where(later(t.order, "purchase_ts") | later(t.order, "delivered_ts")).select(month_of(F.col("purchase_ts")).alias("month"))
    reviewed = t.review.where(later(t.review, "review_ts")).select("order_id").distinct()
    other = t.order.join(reviewed, "order_id", "left_semi").select(month_of(F.col("purchase_ts")).alias("month"))
    return sorted(str(r["month"]) for r in own.union(other).distinct().collect())


class OrderMart:
    """The mart below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str = "") -> list[str]:
        fs, path = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self) -> dict:
        """The published state: version, and the refresh that holds each month."""
        published = [n for n in self._names() if n.startswith("manifest-") and n.endswith(".json")]
        if not published:
            return {"version": 0, "months": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/{published[-1]}", wholetext=True).first()[0])

    def refresh(self, t: Roles, months: list[str] | None = None) -> list[str]:
        """Write the given months anew (all: None) and publish them; the months that were written.

        A month without orders any more leaves the mart.
        """
        state = self.manifest()
        version = state["version"] + 1
        if months is not None:
            wanted = [F.lit(m).cast("date") for m in months]
            t = t.restrict_orders(month_of(F.col("purchase_ts")).isin(*wanted) if wanted else F.lit(False))
        name = f"refresh-{version:06d}-{uuid.uuid4().hex[:8]}"  # a failed refresh leaves nothing that this one writes into
        rows = order_mart(t).withColumn("month", F.col("purchase_month"))
        # Ranges of (month, order): even files however uneven the months are.
        rows.repartitionByRange("month", "order_id").write.partitionBy("month").parquet(f"{self.folder}/{name}")
        written = [n.removeprefix("month=") for n in self._names(name) if n.startswith("month=")]
        kept = {} if months is None else {m: r for m, r in state["months"].items() if m not in set(months)}
        self._publish({"version": version, "months": kept | {m: name for m in written}})
        return written

    def _publish(self, state: dict) -> None:
        fs, target = self._path(f"manifest-{state['version']:06d}.json")
        _, draft = self._path(f"_manifest-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state, indent=1).encode()))
        out.close()
        if not fs.rename(draft, target):  # another refresh published this version first
            fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} of {self.folder} has been published already")

    def read(self, months: list[str] | None = None) -> DataFrame:
        """The rows of the published months (of ``months`` only, if given)."""
        state = self.manifest()["months"]
        paths = [f"{self.folder}/{r}/month={m}" for m, r in sorted(state.items()) if months is None or m in months]
        if not paths:
            raise FileNotFoundError(f"no published month in {self.folder}")
        return self.spark.read.parquet(*paths)

    def vacuum(self) -> list[str]:
        """Delete the months, refreshes and manifests that the last manifest does not name; their names."""
        state = self.manifest()
        live = {(r, f"month={m}") for m, r in state["months"].items()}
        gone = [n for n in self._names() if n.startswith("manifest-") and n != f"manifest-{state['version']:06d}.json"]
        for refresh in (n for n in self._names() if n.startswith("refresh-")):
            if not any(r == refresh for r, _ in live):
                gone.append(refresh)
            else:
                gone += [f"{refresh}/{m}" for m in self._names(refresh) if m.startswith("month=") and (refresh, m) not in live]
        for name in gone:
            fs, path = self._path(name)
            fs.delete(path, True)
        return gone

    def roles(self, t: Roles) -> Roles:
        """Roles for the analyses in ORDER_GRAIN: orders, sums and reviews of the mart, dimensions of ``t``."""
        rows = self.read()
        return Roles(
            customer=t.customer, product=t.product, seller=t.seller, geo=t.geo, description=t.description, materialized=True,
            order=rows.select("order_id", "customer_id", "status", "purchase_ts", "delivered_ts", "promised_ts"),
            payment=rows.where("payments > 0").select("order_id", F.lit(1).alias("seq"), F.lit(None).cast("string").alias("payment_type"),
                                                      F.lit(None).cast("int").alias("installments"), F.col("order_amount").alias("value")),
            item=rows.where("items > 0").select("order_id", F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("string").alias("seller_id"),
                                                F.coalesce("units", F.lit(0)).cast("bigint").alias("units"), F.col("sales").alias("price"), "freight"),
            review=rows.where("reviewed").select("order_id", "score", F.lit(None).cast("timestamp_ntz").alias("review_ts"))).validate()

    def write_dependent(self, t: Roles, out: str, names: tuple[str, ...] = ORDER_GRAIN) -> dict[str, str]:
        """Write the analyses in ORDER_GRAIN from the mart below ``out``; {name: path}."""
        from emporia.plans.catalog import ANALYSES

        base, paths = self.roles(t), {name: f"{out.rstrip('/')}/{name}" for name in names}
        for name, path in paths.items():
            ANALYSES[name].run(base).write.mode("overwrite").parquet(path)
        return paths
