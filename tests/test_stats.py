"""Native statistics columns against closed forms computed in Python."""

import math

import pytest
from pyspark.sql import functions as F

from emporia.functions import stats
from emporia.functions.geo import haversine_km


@pytest.mark.parametrize("z", [-4.0, -1.96, -0.5, 0.0, 0.3, 1.0, 1.6449, 2.5, 5.0])
def test_normal_sf_matches_erfc(spark, z):
    got = spark.range(1).select(stats.normal_sf(F.lit(z)).alias("p")).first().p
    assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-11)


def test_normal_tail_has_no_floor(spark):
    got = spark.range(1).select(stats.normal_sf(F.lit(9.0)).alias("p")).first().p
    assert got == pytest.approx(0.5 * math.erfc(9 / math.sqrt(2)), rel=1e-9)


# Published table values: upper critical values of Student's t.
@pytest.mark.parametrize("t,df,p", [(6.313752, 1, 0.05), (2.919986, 2, 0.05), (2.570582, 5, 0.025), (1.812461, 10, 0.05),
                                    (2.750, 30, 0.005), (1.959964, 1e7, 0.025), (-2.570582, 5, 0.975), (0.0, 3, 0.5)])
def test_student_tail_against_table_values(spark, t, df, p):
    got = spark.range(1).select(stats.student_sf(F.lit(t), F.lit(float(df))).alias("p")).first().p
    assert got == pytest.approx(p, abs=3e-6)


@pytest.mark.parametrize("df", [1e6, 1e8, 1e9, 1e10, 1e12])
def test_student_tail_with_many_degrees_is_the_normal_one(spark, df):
    for t in (-2.0, 0.3, 1.0, 2.0, 4.0, 6.0):
        got = spark.range(1).select(stats.student_sf(F.lit(t), F.lit(df)).alias("p")).first().p
        normal = 0.5 * math.erfc(t / math.sqrt(2))
        first = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * t * (t * t + 1) / (4 * df)
        assert got == pytest.approx(normal + first, rel=1e-11 + 1e5 / df**2, abs=1e-15)


def test_student_tails_meet_where_they_change(spark):
    for t in (0.5, 2.0, 3.5, 5.0):
        a, b = (spark.range(1).select(stats.student_sf(F.lit(t), F.lit(df)).alias("p")).first().p for df in (stats.MANY, stats.MANY * (1 + 1e-12)))
        assert a == pytest.approx(b, abs=1e-11)


def test_welch_small_df(spark):
    cols = [F.lit(v) for v in (5.0, 2.0, 1.0, 5.0, 1.0, 1.0)]
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(stats.welch(*cols, "greater").values(),
                                                              ("t", "df", "p"))]).first()
    assert row.t == pytest.approx(1 / math.sqrt(0.4), abs=1e-6)
    assert row.df == pytest.approx(8.0, abs=1e-6)
    assert 0.05 < row.p < 0.10  # table: 1.397 and 1.860 at 8 degrees of freedom


def test_one_unit_gives_null(spark):
    z = stats.two_proportion(F.lit(1), F.lit(1), F.lit(10), F.lit(40), "greater")
    row = spark.range(1).select(z["z"].alias("z"), z["p_one_sided"].alias("p"),
                                stats.one_sample_proportion_z(F.lit(1), F.lit(1), F.lit(0.2)).alias("one")).first()
    assert (row.z, row.p, row.one) == (None, None, None)


def test_two_proportion_known_value(spark):
    z = stats.two_proportion(F.lit(30), F.lit(40), F.lit(10), F.lit(40), "greater")
    row = spark.range(1).select(z["z"].alias("z"), z["p_one_sided"].alias("p")).first()
    assert row.z == pytest.approx(0.5 / math.sqrt(0.25 * 0.05), abs=1e-6)
    assert row.p == pytest.approx(0.5 * math.erfc(row.z / math.sqrt(2)), abs=2e-9)


def test_ratio_is_null_on_zero(spark):
    assert spark.range(1).select(stats.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None


def test_haversine_quarter_meridian(spark):
    d = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("d")).first().d
    assert d == pytest.approx(math.pi * 6371.0 / 2, rel=1e-12)


@pytest.mark.parametrize("x,k,p", [(11.0705, 5, 0.05), (18.307, 10, 0.05), (3.841459, 1, 0.05), (5.991465, 2, 0.05),
                                   (124.342, 100, 0.05), (0.0, 4, 1.0)])
def test_chi2_tail_against_table_values(spark, x, k, p):
    got = spark.range(1).select(stats.chi2_sf(F.lit(x), F.lit(k)).alias("p")).first().p
    assert got == pytest.approx(p, abs=2e-6)
