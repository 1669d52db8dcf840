"""Plan checks: top-k without a global sort, native expressions only, pushdown."""

import pytest

from emporia.plans.catalog import ANALYSES
from emporia.sources.roles import bind_testdata
from tests.conftest import SF0001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def roles(spark):
    return bind_testdata(spark, SF0001)


@pytest.mark.parametrize("name", ["top_customers", "top_freight_orders", "top_categories_share"])
def test_top_k_uses_take_ordered(roles, name):
    assert "TakeOrderedAndProject" in plan(ANALYSES[name].run(roles))


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_no_python_in_plans(roles, name):
    p = plan(ANALYSES[name].run(roles))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in p


def test_filter_and_pruning_reach_the_scan(roles):
    # Delivery stand-in filters orders on status before joining lines.
    df = ANALYSES["late_vs_ontime_score"].run(roles)
    p = plan(df)
    assert "o_orderstatus,F" in p.replace(" ", "") or "EqualTo(o_orderstatus,F)" in p
    # Column pruning: the documents scan reads only the two columns it needs.
    p2 = plan(ANALYSES["top_customer_category_profile"].run(roles))
    assert "struct<doc_id:bigint,n_chars:bigint>" in p2


def test_repeat_analyses_do_not_window_over_orders(roles):
    """Windows may only sit on small aggregates: no window partitioned by person over orders."""
    for name in ("first_vs_repeat_categories", "repeat_vs_single_score", "repeat_rate", "user_growth"):
        p = plan(ANALYSES[name].run(roles))
        assert "Window [" not in p or "person_id" not in p.split("Window [", 1)[1].split("\n", 1)[0]


def test_only_the_profile_reads_descriptions(roles):
    for name in sorted(ANALYSES):
        assert ("n_chars" in plan(ANALYSES[name].run(roles))) == (name == "top_customer_category_profile"), name


@pytest.mark.parametrize("name", ["top_categories_share", "fastest_growing_categories", "first_vs_repeat_categories"])
def test_products_are_joined_at_product_grain(roles, name):
    """Below the join with the product role there is an aggregate on product_id."""
    p = roles.item.sparkSession._jvm.PythonSQLUtils.explainString(ANALYSES[name].run(roles)._jdf.queryExecution(), "simple")
    at = p.index("p_partkey", p.index("Join"))
    assert "keys=[product_id" in p or "keys=[l_partkey" in p
    assert at


def test_first_orders_make_no_buyer_hot(roles):
    """Orders meet buyers on (buyer, time) only, and nothing is sorted to be aggregated."""
    p = plan(ANALYSES["first_vs_repeat_categories"].run(roles))
    joins = [line for line in p.splitlines() if "Join" in line and "person_id" in line]
    assert joins and all("at#" in line for line in joins) and "SortAggregate" not in p


def test_growth_window_reaches_the_scan(roles):
    p = plan(ANALYSES["fastest_growing_categories"].run(roles))
    assert "o_orderdate" in p and "to_date" not in p.split("FileScan", 1)[0].split("Subquery")[0]


@pytest.mark.parametrize("name", ["late_vs_ontime_score", "hot_slow_bad_review_rate", "repeat_vs_single_score", "seller_bad_review_summary", "first_vs_repeat_categories"])
def test_reviews_are_hash_aggregated(roles, name):
    assert "SortAggregate" not in plan(ANALYSES[name].run(roles))


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_no_cross_or_nested_loop_joins(roles, name):
    p = plan(ANALYSES[name].run(roles))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_seller_view_ranks_no_sellers_in_one_task(spark, roles):
    """Windows without a partition see the histogram of bad reviews only."""
    import re

    from emporia.plans.sql import SPARK_SQL, run_sql
    for name in ("seller_bad_review_concentration", "seller_bad_review_summary"):
        text = run_sql(spark, roles, SPARK_SQL[name])._jdf.queryExecution().executedPlan().toString()
        windows = re.findall(r"(\w+)\([^()]*(?:\([^()]*\)[^()]*)*\) windowspecdefinition\(([^,]*),", text)
        assert windows
        for function, first in windows:
            if " DESC" in first or " ASC" in first:  # no partition column: a single task
                assert function == "sum" and first.startswith("bad#")
        assert not re.search(r"windowspecdefinition\(seller_id", text)


def test_seller_ranks_agree_for_strings_nulls_and_wide_ranges(spark, monkeypatch):
    """The ranges of one value are cut at any ids, and null ids come first."""
    from emporia.plans import sql_text

    rows = [(None if k == 7 else f"s{k * 37 % 500:03d}", 10, k % 3) for k in range(500)]
    df = spark.createDataFrame(rows, "seller_id string, reviews bigint, bad bigint")
    df.createOrReplaceTempView("planted_sellers")
    for slices in (3, sql_text._SLICES):
        text = sql_text.SPARK_SQL["seller_bad_review_concentration"]
        text = text.replace(sql_text._SELLERS, "sellers AS (SELECT * FROM planted_sellers)").replace(f"< {sql_text._SLICES}", f"< {slices}")
        got = {r.seller_id: (r["rank"], r.cum_share) for r in spark.sql(text).collect()}
        want, running, total = {}, 0, sum(r[2] for r in rows)
        for rank, (seller, _, bad) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0] is not None, r[0] or "")), 1):
            running += bad
            want[seller] = (rank, round(running / total, 6))
        assert got == want
