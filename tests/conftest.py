from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emporia.sources.roles import Roles  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"

ROLE_DDL = {
    "customer": "customer_id string, person_id string, city string, state string, geo_key string",
    "order": ("order_id string, customer_id string, status string, purchase_ts timestamp_ntz, "
              "delivered_ts timestamp_ntz, promised_ts timestamp_ntz"),
    "item": ("order_id string, product_id string, seller_id string, units bigint, "
             "price decimal(12,2), freight decimal(12,2)"),
    "product": ("product_id string, category string, name_len int, desc_len int, photo_cnt int, "
                "weight_g double, length_cm double, height_cm double, width_cm double"),
    "payment": "order_id string, seq int, payment_type string, installments int, value decimal(12,2)",
    "review": "order_id string, score int, review_ts timestamp_ntz",
    "seller": "seller_id string, city string, state string, geo_key string",
    "geo": "geo_key string, lat double, lng double",
}


@pytest.fixture(scope="session")
def spark():
    from emporia.session import local_session

    s = local_session(4, shuffle_partitions=4, app="emporia-tests")
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture(scope="session")
def make_roles(spark):
    """Build a Roles holder from row lists; missing roles are empty."""

    def build(**rows) -> Roles:
        frames = {role: spark.createDataFrame(rows.get(role, []), ROLE_DDL[role]) for role in ROLE_DDL}
        return Roles(**frames)

    return build


def product_row(pid, category="A", weight=100.0):
    return (pid, category, 10, 100, 2, weight, 10.0, 10.0, 10.0)
