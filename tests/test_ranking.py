"""Distributed global rank equals a single-partition window, ties included."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from emporia.functions.ranking import global_rank


def test_global_rank_matches_window(spark):
    df = spark.range(0, 5000).select(
        F.format_string("s%05d", ((F.col("id") * 7919) % 5000)).alias("seller_id"),
        (F.col("id") % 13).alias("bad"))  # heavy ties on bad
    order = [F.col("bad").desc(), F.col("seller_id").asc()]
    got = global_rank(df, order, rank="rank", running="bad", running_out="cum", parts=7)
    w = Window.orderBy(*order)
    exp = df.select("seller_id", F.row_number().over(w).alias("rank"),
                    F.sum("bad").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    a = sorted((r.seller_id, r.rank, r.cum) for r in got.collect())
    b = sorted((r.seller_id, r.rank, r.cum) for r in exp.collect())
    assert a == b
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_global_rank_small_input_more_parts_than_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "k string, v int")
    got = global_rank(df, [F.col("v").desc(), F.col("k")], parts=8)
    assert sorted((r.k, r.rank) for r in got.collect()) == [("a", 3), ("b", 1), ("c", 2)]
