"""Least squares from moments, as native columns.

The moments of a regression (sums of products of its variables) are one row,
whatever the data: a hash aggregate with partial sums.  The normal equations
are then solved in columns of that row by Cholesky's method on centred moments,
step by step (each step is a projection of a few columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A variable whose variance given the ones before it is at most this share of its own adds nothing and is left out.
ALIASED = 1e-9


def moments(x: list[Column], y: Column) -> dict[str, Column]:
    """Aggregates n, sx_i, sxx_i_j (i >= j), sxy_i, sy, syy over rows whose variables are all known."""
    known = y.isNotNull()
    for c in x:
        known = known & c.isNotNull()
    v = [F.when(known, c.cast("double")) for c in x]
    w = F.when(known, y.cast("double"))
    out = {"n": F.count_if(known), "sy": F.sum(w), "syy": F.sum(w * w)}
    for i, a in enumerate(v):
        out |= {f"sx_{i}": F.sum(a), f"sxy_{i}": F.sum(a * w)}
        out |= {f"sxx_{i}_{j}": F.sum(a * v[j]) for j in range(i + 1)}
    return out


def summed(names: list[str]) -> dict[str, Column]:
    """Aggregates that add up rows of moments."""
    return {name: F.sum(name) for name in names}


def least_squares(m: DataFrame, k: int) -> DataFrame:
    """The row of ``moments`` of k variables plus beta_i, se_i (null where variable i is aliased), beta_c, se_c (constant), r2 and df.

    Ordinary least squares with a constant; se is null without spare degrees of freedom.
    """
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))
    r = range(k)

    def centred(a, b, c):
        return F.col(a) - F.col(b) * F.col(c) / n

    m = m.withColumns({f"c_{i}_{j}": centred(f"sxx_{i}_{j}", f"sx_{i}", f"sx_{j}") for i in r for j in range(i + 1)}
                      | {f"d_{i}": centred(f"sxy_{i}", f"sx_{i}", "sy") for i in r} | {"yy": centred("syy", "sy", "sy")})
    for j in r:  # the Cholesky factor, column by column; q is 1 over its diagonal, 0 where it vanishes
        left = F.col(f"c_{j}_{j}")
        for p in range(j):
            left = left - F.col(f"l_{j}_{p}") * F.col(f"l_{j}_{p}")
        m = m.withColumn(f"v_{j}", left)
        alive = F.col(f"v_{j}") > ALIASED * F.col(f"c_{j}_{j}")
        m = m.withColumns({f"q_{j}": F.when(alive, 1.0 / F.sqrt(F.col(f"v_{j}"))).otherwise(0.0), f"alive_{j}": F.coalesce(alive, F.lit(False))})
        rows = {}
        for i in range(j + 1, k):
            left = F.col(f"c_{i}_{j}")
            for p in range(j):
                left = left - F.col(f"l_{i}_{p}") * F.col(f"l_{j}_{p}")
            rows[f"l_{i}_{j}"] = left * F.col(f"q_{j}")
        m = m.withColumns(rows) if rows else m
    for i in r:  # L z = d
        left = F.col(f"d_{i}")
        for p in range(i):
            left = left - F.col(f"l_{i}_{p}") * F.col(f"z_{p}")
        m = m.withColumn(f"z_{i}", left * F.col(f"q_{i}"))
    for i in r:  # the inverse of L, row by row
        rows = {f"w_{i}_{i}": F.col(f"q_{i}")}
        for j in range(i):
            left = F.lit(0.0)
            for p in range(j, i):
                left = left + F.col(f"l_{i}_{p}") * F.col(f"w_{p}_{j}")
            rows[f"w_{i}_{j}"] = -left * F.col(f"q_{i}")
        m = m.withColumns(rows)

    def total(terms):
        out = F.lit(0.0)
        for t in terms:
            out = out + t
        return out

    # beta = W' z, the inverse of the moments = W' W.
    m = m.withColumns({f"b_{i}": total(F.col(f"w_{p}_{i}") * F.col(f"z_{p}") for p in range(i, k)) for i in r}
                      | {f"i_{i}_{j}": total(F.col(f"w_{p}_{i}") * F.col(f"w_{p}_{j}") for p in range(max(i, j), k)) for i in r for j in range(i + 1)})
    used = total(F.col(f"alive_{i}").cast("double") for i in r)
    explained = total(F.col(f"z_{i}") * F.col(f"z_{i}") for i in r)
    m = m.withColumns({"explained": explained, "df": n - 1.0 - used})
    m = m.withColumn("s2", F.when(F.col("df") >= 1, F.greatest(F.col("yy") - F.col("explained"), F.lit(0.0)) / F.col("df")))

    def inverse(i, j):
        return F.col(f"i_{max(i, j)}_{min(i, j)}")

    around = total(F.col(f"sx_{i}") * F.col(f"sx_{j}") * inverse(i, j) for i in r for j in r) / (n * n)
    out = {f"beta_{i}": F.when(F.col(f"alive_{i}"), F.col(f"b_{i}")) for i in r}
    out |= {f"se_{i}": F.when(F.col(f"alive_{i}"), F.sqrt(F.col("s2") * F.col(f"i_{i}_{i}"))) for i in r}
    out |= {"beta_c": (F.col("sy") - total(F.col(f"b_{i}") * F.col(f"sx_{i}") for i in r)) / n,
            "se_c": F.sqrt(F.col("s2") * (1.0 / n + around)), "r2": F.when(F.col("yy") > 0, F.least(F.col("explained") / F.col("yy"), F.lit(1.0)))}
    return m.withColumns(out)
