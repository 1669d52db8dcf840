"""Role tables and the binding for the driver's test tables.

Analyses are written against *roles*, never against physical tables:

=========  ==========================  =====================================================
role       key                         columns
=========  ==========================  =====================================================
customer   customer_id                 person_id, city, state, geo_key
order      order_id                    customer_id, status, purchase_ts, delivered_ts, promised_ts
item       (bag of rows)               order_id, product_id, seller_id, units, price, freight
product    product_id                  category, name_len, photo_cnt, weight_g,
                                       length_cm, height_cm, width_cm
description  product_id                desc_len
payment    (order_id, seq)             payment_type, installments, value
review     order_id (one per order)    score, review_ts
seller     seller_id                   city, state, geo_key
geo        geo_key                     lat, lng
=========  ==========================  =====================================================

``person_id`` is the stable buyer; ``customer_id`` may be issued per order.
Every repeat-buying analysis groups on ``person_id``.

Bindings return *lazy* DataFrames: nothing is read until an analysis runs,
and Catalyst prunes each role down to the columns that analysis touches.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLE_COLUMNS: dict[str, tuple[str, ...]] = {
    "customer": ("customer_id", "person_id", "city", "state", "geo_key"),
    "order": ("order_id", "customer_id", "status", "purchase_ts", "delivered_ts", "promised_ts"),
    "item": ("order_id", "product_id", "seller_id", "units", "price", "freight"),
    "product": ("product_id", "category", "name_len", "photo_cnt", "weight_g",
                "length_cm", "height_cm", "width_cm"),
    "description": ("product_id", "desc_len"),
    "payment": ("order_id", "seq", "payment_type", "installments", "value"),
    "review": ("order_id", "score", "review_ts"),
    "seller": ("seller_id", "city", "state", "geo_key"),
    "geo": ("geo_key", "lat", "lng"),
}

MONEY = "decimal(12,2)"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Kinds of the columns: the types that a role accepts.  All others are keys (text or integral).
KINDS: dict[str, tuple[type, ...]] = {
    "city": (T.StringType,), "state": (T.StringType,), "status": (T.StringType,), "category": (T.StringType,),
    "payment_type": (T.StringType,),
    **{c: (T.TimestampNTZType, T.TimestampType) for c in ("purchase_ts", "delivered_ts", "promised_ts", "review_ts")},
    **{c: INTEGRAL for c in ("units", "seq", "installments", "score", "name_len", "desc_len", "photo_cnt")},
    **{c: (T.DecimalType,) for c in ("price", "freight", "value")},
    **{c: (T.DoubleType, T.FloatType, T.DecimalType, *INTEGRAL) for c in ("weight_g", "length_cm", "height_cm", "width_cm", "lat", "lng")},
}
KEY = (T.StringType, *INTEGRAL)


@dataclass(frozen=True)
class Roles:
    """Holder of the role DataFrames (all lazy).

    ``description`` defaults to the product role's own ``desc_len``.
    """

    customer: DataFrame
    order: DataFrame
    item: DataFrame
    product: DataFrame
    payment: DataFrame
    review: DataFrame
    seller: DataFrame
    geo: DataFrame
    description: DataFrame | None = None
    materialized: bool = False  # read from tables of their own: no need to store them again

    def __post_init__(self) -> None:
        if self.description is None:
            object.__setattr__(self, "description", self.product.select("product_id", "desc_len"))

    def restrict_orders(self, condition: Column) -> "Roles":
        """Same roles for the orders that meet ``condition`` (e.g. one calendar year).

        Items, payments and reviews of other orders go as well (semi joins on
        ``order_id``), because several analyses read them directly.
        """
        order = self.order.filter(condition)
        ids = order.select("order_id")
        return replace(self, materialized=False, order=order, **{
            role: getattr(self, role).join(ids, "order_id", "left_semi") for role in ("item", "payment", "review")})

    def validate(self) -> "Roles":
        """These roles, if every required column is there with a type of its kind (schemas only, no job)."""
        for role, cols in ROLE_COLUMNS.items():
            have = {f.name: f.dataType for f in getattr(self, role).schema.fields}
            missing = [c for c in cols if c not in have]
            if missing:
                raise ValueError(f"role {role!r} lacks columns {missing}")
            for c in cols:
                if not isinstance(have[c], KINDS.get(c, KEY)):
                    raise TypeError(f"column {c!r} of role {role!r} is {have[c].simpleString()}; "
                                    f"accepted: {', '.join(k.typeName() for k in KINDS.get(c, KEY))}")
        return self


def in_year(year: int) -> Column:
    """Order-role predicate: purchased in the given calendar year."""
    return (F.col("purchase_ts") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (
        F.col("purchase_ts") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))


# Schemas of the driver's test tables (TESTDATA.md), so binding
# reads no parquet footers to infer them.
TESTDATA_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def bind_testdata(spark: SparkSession, sf_dir: str) -> Roles:
    """Bind the driver's TPC-H-like tables to roles (stand-ins, FIXTURES.md §2).

    The stand-ins exercise every operator; their values carry no business
    meaning.  Nation and region are the fixed 25- and 5-row TPC-H dimensions,
    so broadcasting them is safe at any scale factor.
    """

    def read(name: str) -> DataFrame:
        return spark.read.schema(TESTDATA_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    nation = read("nation")
    region = read("region")
    place = F.broadcast(
        nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("nationkey"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.col("n_nationkey").cast("bigint").alias("geo_key"),
        )
    )

    customer = (
        read("customer")
        .select("c_custkey", "c_nationkey")
        .join(place, F.col("c_nationkey") == F.col("nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("person_id"),
            "city", "state", "geo_key",
        )
    )

    seller = (
        read("supplier")
        .select("s_suppkey", "s_nationkey")
        .join(place, F.col("s_nationkey") == F.col("nationkey"))
        .select(F.col("s_suppkey").alias("seller_id"), "city", "state", "geo_key")
    )

    geo = nation.select(
        F.col("n_nationkey").cast("bigint").alias("geo_key"),
        (F.lit(-30) + F.col("n_nationkey")).cast("double").alias("lat"),
        (F.lit(-60.0) + F.lit(1.5) * F.col("n_nationkey")).alias("lng"),
    )

    # Text lengths of documents stand in for description lengths; a role of its own, so that
    # only the analysis that reads them scans the documents.
    description = read("documents").select(
        F.col("doc_id").alias("product_id"), F.col("n_chars").cast("int").alias("desc_len"))
    size = F.col("p_size")
    product = (
        read("part")
        .select("p_partkey", "p_name", "p_brand", "p_size")
        .select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_brand").alias("category"),
            F.length("p_name").cast("int").alias("name_len"),
            (size % 6 + 1).cast("int").alias("photo_cnt"),
            (size * 100).cast("double").alias("weight_g"),
            size.cast("double").alias("length_cm"),
            (size % 7 + 2).cast("double").alias("height_cm"),
            (size % 11 + 5).cast("double").alias("width_cm"),
        )
    )

    lineitem = read("lineitem")
    price = F.col("l_extendedprice").cast(MONEY)
    item = lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_quantity").cast("bigint").alias("units"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(16,4)").alias("freight"),
    )

    orders = read("orders")
    # Delivery stand-in: only finished ('F') orders are delivered; the delay is
    # derived from their lines, so the filter is pushed to the orders scan
    # before the join and only delivered orders' lines are shuffled.
    finished = orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderdate")
    lag = F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))
    delay = (
        lineitem.select("l_orderkey", "l_shipdate")
        .join(finished, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_orderkey")
        .agg(F.max(((lag % 60) + 60) % 60).alias("delay_days"))
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .when(F.col("o_orderstatus") == "P", "canceled")
    )
    order = (
        orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        .join(delay, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("status"),
            F.col("o_orderdate").alias("purchase_ts"),
            F.when(
                F.col("o_orderstatus") == "F",
                F.col("o_orderdate") + F.make_dt_interval(days=F.col("delay_days")),
            ).alias("delivered_ts"),
            (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(55))).alias("promised_ts"),
        )
    )

    # Payments: one row per order plus a voucher row for every 20th order.
    # Generated from a single scan of orders (Generate, no union of two scans).
    key = F.col("o_orderkey")
    voucher = key % 20 == 0
    first = F.struct(
        F.lit(1).alias("seq"),
        F.col("o_orderpriority").alias("payment_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", key % 10 + 1).otherwise(1)
        .cast("int").alias("installments"),
        F.when(voucher, F.col("o_totalprice").cast(MONEY) - F.lit(10).cast(MONEY))
        .otherwise(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("value"),
    )
    second = F.struct(
        F.lit(2).alias("seq"),
        F.lit("VOUCHER").alias("payment_type"),
        F.lit(1).alias("installments"),
        F.lit(10).cast(MONEY).alias("value"),
    )
    payment = (
        orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
        .select(key.alias("order_id"),
                F.inline(F.when(voucher, F.array(first, second)).otherwise(F.array(first))))
    )

    n = F.count(F.lit(1))
    r = F.count_if(F.col("l_returnflag") == "R")
    review = (
        lineitem.groupBy("l_orderkey")
        .agg(n.alias("n"), r.alias("r"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.when(F.col("r") == 0, 5)
            .when(F.col("r") * 10 < F.col("n") * 3, 4)
            .when(F.col("r") * 20 < F.col("n") * 9, 3)
            .when(F.col("r") * 10 < F.col("n") * 7, 2)
            .otherwise(1).cast("int").alias("score"),
            F.lit(None).cast("timestamp_ntz").alias("review_ts"),
        )
    )

    return Roles(customer=customer, order=order, item=item, product=product,
                 payment=payment, review=review, seller=seller, geo=geo, description=description).validate()
