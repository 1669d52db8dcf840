"""Sources and sinks: the public marketplace CSV files, parquet roles, marts.

* :func:`read_csv_roles` (X1) reads the marketplace dataset's CSV files with
  fixed schemas (never ``inferSchema``) and binds them to roles, handling the
  dataset's traps: the stable buyer is ``customer_unique_id``; geolocation has
  many points per zip prefix (averaged to one); an order can have several
  reviews (the latest is kept by :func:`emporia.plans.bases.order_review`).
* :func:`read_parquet_roles` / :func:`write_roles` (X2) store and load role
  tables as parquet, one folder per role.
* :func:`write_marts` (X4) writes every analysis as a parquet table for a BI
  tool.  It first materializes the roles once into the session's checkpoint
  folder (``spark.checkpoint.dir``, a shared folder on a cluster), which cuts
  lineage so a lost executor re-reads compact role files instead of
  recomputing joins, and lets the ~30 analyses share one set of scans.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emporia.sources.roles import ROLE_COLUMNS, Roles

# File names and columns of the public marketplace dataset.
CSV_FILES = {
    "customers": "olist_customers_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
}

S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CSV_SCHEMAS = {
    "customers": _schema(("customer_id", S), ("customer_unique_id", S),
                         ("customer_zip_code_prefix", S), ("customer_city", S), ("customer_state", S)),
    "geolocation": _schema(("geolocation_zip_code_prefix", S), ("geolocation_lat", D),
                           ("geolocation_lng", D), ("geolocation_city", S), ("geolocation_state", S)),
    "order_items": _schema(("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
                           ("shipping_limit_date", TS), ("price", MONEY), ("freight_value", MONEY)),
    "order_payments": _schema(("order_id", S), ("payment_sequential", I), ("payment_type", S),
                              ("payment_installments", I), ("payment_value", MONEY)),
    "order_reviews": _schema(("review_id", S), ("order_id", S), ("review_score", I),
                             ("review_comment_title", S), ("review_comment_message", S),
                             ("review_creation_date", TS), ("review_answer_timestamp", TS)),
    "orders": _schema(("order_id", S), ("customer_id", S), ("order_status", S),
                      ("order_purchase_timestamp", TS), ("order_approved_at", TS),
                      ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
                      ("order_estimated_delivery_date", TS)),
    "products": _schema(("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
                        ("product_description_lenght", I), ("product_photos_qty", I),
                        ("product_weight_g", D), ("product_length_cm", D), ("product_height_cm", D),
                        ("product_width_cm", D)),
    "sellers": _schema(("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S),
                       ("seller_state", S)),
    "category_translation": _schema(("product_category_name", S), ("product_category_name_english", S)),
}

# Only the reviews file has quoted line breaks (free-text comments).  multiLine
# stops Spark from splitting a file, so it is used there and nowhere else.  A
# large set of reviews comes as a folder of CSV files under the same name: one
# task reads each file (and the whole of a single file).
MULTILINE = {"order_reviews"}


def read_csv_table(spark: SparkSession, directory: str, name: str, mode: str = "FAILFAST") -> DataFrame:
    """One dataset file with its fixed schema."""
    reader = (
        spark.read.schema(CSV_SCHEMAS[name])
        .option("header", True)
        .option("mode", mode)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("multiLine", name in MULTILINE)
    )
    return reader.csv(f"{directory}/{CSV_FILES[name]}")


def _zip(col: str) -> F.Column:
    return F.lpad(F.trim(F.col(col)), 5, "0")


def read_csv_roles(spark: SparkSession, directory: str, english_categories: bool = True,
                   mode: str = "FAILFAST") -> Roles:
    """Bind the marketplace dataset's CSV files to roles."""

    def read(name: str) -> DataFrame:
        return read_csv_table(spark, directory, name, mode)

    customer = read("customers").select(
        "customer_id", F.col("customer_unique_id").alias("person_id"),
        F.col("customer_city").alias("city"), F.col("customer_state").alias("state"),
        _zip("customer_zip_code_prefix").alias("geo_key"))
    seller = read("sellers").select(
        "seller_id", F.col("seller_city").alias("city"), F.col("seller_state").alias("state"),
        _zip("seller_zip_code_prefix").alias("geo_key"))
    geo = read("geolocation").groupBy(_zip("geolocation_zip_code_prefix").alias("geo_key")).agg(
        F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng"))
    order = read("orders").select(
        "order_id", "customer_id", F.col("order_status").alias("status"),
        F.col("order_purchase_timestamp").alias("purchase_ts"),
        F.col("order_delivered_customer_date").alias("delivered_ts"),
        F.col("order_estimated_delivery_date").alias("promised_ts"))
    item = read("order_items").select(
        "order_id", "product_id", "seller_id", F.lit(1).cast("bigint").alias("units"),
        "price", F.col("freight_value").alias("freight"))
    products = read("products")
    category = F.col("product_category_name")
    if english_categories:
        products = products.join(read("category_translation"), "product_category_name", "left")
        category = F.coalesce(F.col("product_category_name_english"), F.col("product_category_name"))
    product = products.select(
        "product_id", category.alias("category"),
        F.col("product_name_lenght").alias("name_len"),
        F.col("product_photos_qty").alias("photo_cnt"),
        F.col("product_weight_g").alias("weight_g"),
        F.col("product_length_cm").alias("length_cm"),
        F.col("product_height_cm").alias("height_cm"),
        F.col("product_width_cm").alias("width_cm"))
    description = products.select("product_id", F.col("product_description_lenght").alias("desc_len"))
    payment = read("order_payments").select(
        "order_id", F.col("payment_sequential").alias("seq"), "payment_type",
        F.col("payment_installments").alias("installments"), F.col("payment_value").alias("value"))
    review = read("order_reviews").select(
        "order_id", F.col("review_score").alias("score"),
        F.coalesce(F.col("review_answer_timestamp"), F.col("review_creation_date")).alias("review_ts"))
    return Roles(customer=customer, order=order, item=item, product=product, payment=payment,
                 review=review, seller=seller, geo=geo, description=description).validate()


def write_roles(t: Roles, directory: str) -> None:
    """Write every role as parquet under ``directory/<role>`` (X2 sink)."""
    for role, cols in ROLE_COLUMNS.items():
        getattr(t, role).select(*cols).write.mode("overwrite").parquet(f"{directory}/{role}")


def read_parquet_roles(spark: SparkSession, directory: str) -> Roles:
    """Load roles written by :func:`write_roles` (X2); columns and types are checked."""
    return Roles(**{role: spark.read.parquet(f"{directory}/{role}") for role in ROLE_COLUMNS}, materialized=True).validate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; set one only where it is unset (tests)."""
    from emporia.session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(spark)


def materialize_roles(t: Roles, folder: str) -> Roles:
    """Write the roles once below ``folder`` and read them back.

    Cuts lineage (a lost executor recomputes from these files, not from the
    source joins) and lets many analyses share one materialization.
    """
    write_roles(t, folder)
    return read_parquet_roles(t.order.sparkSession, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this session's own through the file system it lies in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_marts(t: Roles, out: str, names: list[str] | None = None,
                materialize: bool | None = None, concurrency: int = 1,
                fmt: str = "parquet") -> dict[str, str]:
    """Write each analysis under ``out/<name>`` for a BI tool.

    Returns {name: path}.  Marts are small aggregates (one row per month,
    category, city, seller...), so they are written without partitioning.
    Derived roles are materialized first, below the checkpoint folder, and
    that copy is deleted at the end; roles read from parquet are not copied
    (``materialize`` forces either).
    ``concurrency`` > 1 submits independent analyses from a thread pool so
    their jobs share the cluster; each analysis is still one Spark job graph.
    ``fmt="noop"`` runs everything without writing (benchmarks).
    """
    from concurrent.futures import ThreadPoolExecutor

    from emporia.plans.catalog import ANALYSES

    spark = t.order.sparkSession
    copy = None
    if not t.materialized if materialize is None else materialize:
        copy = f"{checkpoint_folder(spark).rstrip('/')}/emporia-roles-{uuid.uuid4().hex}"
    todo = list(names or ANALYSES)
    paths = {name: f"{out.rstrip('/')}/{name}" for name in todo}

    def run(name: str) -> None:
        w = ANALYSES[name].run(base).write.mode("overwrite")
        if fmt == "noop":
            w.format("noop").save()
        else:
            w.format(fmt).save(paths[name])

    try:
        base = materialize_roles(t, copy) if copy else t
        if concurrency <= 1:
            for name in todo:
                run(name)
        else:
            with ThreadPoolExecutor(max_workers=concurrency) as pool:
                list(pool.map(run, todo))
    finally:
        if copy:
            delete_folder(spark, copy)
    return paths
