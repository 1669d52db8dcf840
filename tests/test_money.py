"""Exact money sums: decimals of any width, refusal of binary floating point."""

from decimal import Context, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from emporia.functions.money import as_money, exact_sum, money_of


def total(df, col="v"):
    return df.agg(exact_sum(F.col(col), money_of(df, col)).alias("s")).first().s


def test_exact_sum_matches_decimal_sum(spark):
    rows = [("a", Decimal("0.01")), ("a", Decimal("-10.05")), ("a", None), ("b", Decimal("99999999.99")),
            ("b", Decimal("0.10")), ("b", Decimal("0.20")), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v decimal(12,2)")
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum(F.col("v"), money_of(df, "v")).alias("s")).collect()}
    assert got == {"a": Decimal("-10.04"), "b": Decimal("100000000.29"), "c": None}


@pytest.mark.parametrize("kind,values", [
    ("decimal(16,4)", ["900719925474.0993", "49999999999.1993"]),
    ("decimal(16,4)", ["999999999999.9999"] * 3),
    ("decimal(20,8)", ["1.12345678", "-0.00000001"]),
    ("decimal(18,2)", ["9007199254740993.01", "0.01"]),  # above 2^53 units
    ("decimal(38,10)", ["1234567890123456789012345678.0123456789", "0.0000000001"]),
    ("decimal(12,0)", ["5", "6"]),
])
def test_exact_sum_keeps_every_digit(spark, kind, values):
    values = [Decimal(v) for v in values]
    with localcontext(Context(prec=60)):
        assert total(spark.createDataFrame([(v,) for v in values], f"v {kind}")) == sum(values)


def test_floating_point_is_refused_or_rounded(spark):
    df = spark.createDataFrame([(10.75,), (0.99,), (0.105,)], "v double")
    with pytest.raises(TypeError):
        money_of(df, "v")
    assert total(df.select(as_money(F.col("v")).alias("v"))) == Decimal("11.85")
    assert total(spark.createDataFrame([(7,), (8,)], "v bigint")) == 15
