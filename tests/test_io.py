"""Sources and sinks: CSV roles (X1), parquet roles (X2), SQL views (X3), marts."""

import math

import pytest
from pyspark.sql import functions as F

from emporia.operators import customers, logistics
from emporia.plans.catalog import ANALYSES
from emporia.plans.sql import SPARK_SQL, register_views, run_sql
from emporia.sources.io import CSV_FILES, read_csv_roles, read_parquet_roles, write_marts, write_roles
from emporia.sources.roles import bind_testdata
from tests.conftest import SF0001

CSV = {
    "customers": [
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state",
        "c1,u1,01037,sao paulo,SP",
        "c2,u1,01037,sao paulo,SP",
        "c3,u2,20000,rio de janeiro,RJ",
    ],
    "geolocation": [
        "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state",
        "01037,-23.0,-46.0,sao paulo,SP",
        "01037,-23.2,-46.2,sao paulo,SP",
        "20000,-22.9,-43.2,rio de janeiro,RJ",
        "1037,-23.1,-46.1,sao paulo,SP",
    ],
    "orders": [
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date",
        "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,2017-10-04 19:55:00,"
        "2017-10-10 21:25:13,2017-10-18 00:00:00",
        "o2,c2,delivered,2018-01-05 08:00:00,,,2018-02-01 10:00:00,2018-01-20 00:00:00",
        "o3,c3,canceled,2018-02-01 09:30:00,,,,2018-02-20 00:00:00",
    ],
    "order_items": [
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value",
        "o1,1,p1,s1,2017-10-06 11:07:15,29.99,8.72",
        "o1,2,p2,s1,2017-10-06 11:07:15,10.00,8.72",
        "o2,1,p1,s2,2018-01-10 00:00:00,29.99,15.10",
    ],
    "order_payments": [
        "order_id,payment_sequential,payment_type,payment_installments,payment_value",
        "o1,1,credit_card,2,30.00",
        "o1,2,voucher,1,27.43",
        "o2,1,boleto,1,45.09",
        "o3,1,credit_card,3,50.00",
    ],
    "order_reviews": [
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp",
        'r1,o1,4,,"good, but\nslow",2017-10-11 00:00:00,2017-10-12 03:43:48',
        'r2,o1,2,,"changed my mind",2017-10-20 00:00:00,2017-10-21 10:00:00',
        "r3,o2,1,,,2018-02-02 00:00:00,2018-02-03 00:00:00",
    ],
    "products": [
        "product_id,product_category_name,product_name_lenght,product_description_lenght,"
        "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm",
        "p1,perfumaria,40,287,1,225,16,10,14",
        "p2,,,,,1000,30,30,30",
    ],
    "sellers": [
        "seller_id,seller_zip_code_prefix,seller_city,seller_state",
        "s1,20000,rio de janeiro,RJ",
        "s2,01037,sao paulo,SP",
    ],
    "category_translation": [
        "product_category_name,product_category_name_english",
        "perfumaria,perfumery",
    ],
}


@pytest.fixture(scope="module")
def csv_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("marketplace-csv")
    for name, lines in CSV.items():
        (d / CSV_FILES[name]).write_text("\n".join(lines) + "\n")
    return str(d)


def test_csv_roles_bind_and_handle_traps(spark, csv_dir):
    t = read_csv_roles(spark, csv_dir)
    t.validate()
    assert t.review.count() == 3  # the quoted line break did not split a record
    geo = {r.geo_key: (round(r.lat, 6), round(r.lng, 6)) for r in t.geo.collect()}
    assert geo["01037"] == (-23.1, -46.1)  # three points of one zip prefix averaged
    r = customers.repeat_rate(t).first()
    assert (r.customers, r.repeat_customers) == (2, 1)  # c1 and c2 are one person
    cats = {r.product_id: r.category for r in t.product.collect()}
    assert cats == {"p1": "perfumery", "p2": None}
    top = {r.order_id: r for r in logistics.top_freight_orders(t).collect()}
    assert top["o1"].freight == pytest.approx(17.44)
    # Rio seller to Sao Paulo buyer, averaged coordinates, rounded to metres.
    la1, lo1, la2, lo2 = map(math.radians, (-23.1, -46.1, -22.9, -43.2))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    assert top["o1"].distance_km == pytest.approx(2 * 6371.0 * math.asin(math.sqrt(h)), abs=1e-3)
    late = logistics.late_vs_ontime_score(t).first()
    assert (late.n_late, late.n_ontime) == (1, 1)  # o2 late, scored 1; o1 on time, latest review 2


def test_parquet_roles_round_trip(spark, tmp_path):
    t = bind_testdata(spark, SF0001)
    write_roles(t, str(tmp_path / "roles"))
    back = read_parquet_roles(spark, str(tmp_path / "roles"))
    a = [tuple(r) for r in customers.top_customers(t).orderBy("rank").collect()]
    b = [tuple(r) for r in customers.top_customers(back).orderBy("rank").collect()]
    assert a == b


def test_write_marts(spark, tmp_path):
    t = bind_testdata(spark, SF0001)
    names = ["top_customers", "sales_growth", "installment_avg_payment"]
    paths = write_marts(t, str(tmp_path / "marts"), names=names, concurrency=2)
    for name in names:
        assert spark.read.parquet(paths[name]).count() == ANALYSES[name].run(t).count()


def test_marts_of_csv_cover_the_whole_history(spark, csv_dir, tmp_path):
    """Orders of 2017-2018: repeat marts must not be cut to another window."""
    from emporia.__main__ import main

    paths = write_marts(read_csv_roles(spark, csv_dir), str(tmp_path / "m"), names=["repeat_rate", "first_vs_repeat_categories"])
    r = spark.read.parquet(paths["repeat_rate"]).first()
    assert (r.customers, r.repeat_customers, r.repeat_rate) == (2, 1, 0.5)
    assert spark.read.parquet(paths["first_vs_repeat_categories"]).count() == 2
    assert main(["marts", "--csv", csv_dir, "--out", str(tmp_path / "cli"), "--only", "repeat_rate"]) == 0
    assert spark.read.parquet(str(tmp_path / "cli/repeat_rate")).first().repeat_customers == 1


def test_marts_leave_no_copy_of_the_roles(spark, tmp_path):
    from emporia.sources.io import checkpoint_folder

    def copies():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_folder(spark))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path) if "emporia-roles" in s.getPath().getName()] if fs.exists(path) else []

    write_marts(bind_testdata(spark, SF0001), str(tmp_path / "m"), names=["repeat_rate"])
    assert copies() == []


def test_roles_check_types(spark, tmp_path):
    t = bind_testdata(spark, SF0001)
    write_roles(t, str(tmp_path / "roles"))
    t.item.withColumn("price", F.col("price").cast("double")).write.mode("overwrite").parquet(str(tmp_path / "roles/item"))
    with pytest.raises(TypeError, match="price"):
        read_parquet_roles(spark, str(tmp_path / "roles"))


def test_views_start_no_job(spark):
    t = bind_testdata(spark, SF0001)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("views", "registering")
    try:
        register_views(t, analyses=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(tracker.getJobIdsForGroup("views")) == []


def _rows(df):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(SPARK_SQL))
def test_sql_text_equals_dataframe(spark, name):
    t = bind_testdata(spark, SF0001)
    via_sql = run_sql(spark, t, SPARK_SQL[name])
    via_df = ANALYSES[name].fn(t)
    assert via_sql.columns == via_df.columns
    assert _rows(via_sql) == _rows(via_df)


def test_analysis_views(spark):
    t = bind_testdata(spark, SF0001)
    names = register_views(t, analyses=True)
    assert "a_top_customers" in names and "r_order" in names
    assert spark.sql("SELECT count(*) AS n FROM a_top_customers").first().n == 100
