"""Connected components by alternating large-star and small-star steps.

Every edge is a row (hi, lo) with hi > lo.  A round points each node's larger
neighbours at the smallest node next to it (large star) and then each node's
smaller neighbours at the smallest of them (small star); the rounds end when
all edges lead straight to their component's smallest node.  State is a table
of edges in the shared folder; nothing is collected but one row of counts.
Tables of a round are written in a file for every ROWS edges, so that few edges
do not become a file for every shuffle partition in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

ROWS = 1 << 14


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges`` that is not the smallest of its component."""
    now = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    files = max(1, -(-now.count() // ROWS))
    while True:
        # Least smaller neighbour of each node; a stored table, so that joins on hub nodes can be split.
        least = stored(now.groupBy("hi").agg(F.min("lo").alias("least"), F.count("lo").alias("n")).withColumnRenamed("hi", "node").coalesce(files), "least")
        joined = now.join(least, now["lo"] == least["node"], "left")
        open_ = joined.where(F.col("node").isNotNull()).limit(1).count() + least.where("n > 1").limit(1).count()
        if not open_:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        large = stored(joined.select("hi", F.coalesce("least", "lo").alias("lo")).distinct().coalesce(files), "large-star")
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("least")).withColumnRenamed("hi", "node").coalesce(files), "least")
        small = large.join(least, large["hi"] == least["node"])
        pairs = F.array(F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))
        now = stored(small.select(F.explode(pairs).alias("p")).select("p.hi", "p.lo").where("hi <> lo").distinct().coalesce(files), "small-star")
