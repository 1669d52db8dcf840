"""Significance tests as native Column expressions.

Spark has no ``erf``, ``lgamma`` or incomplete beta, and scipy is not assumed:
the tails are series and continued fractions of a fixed number of terms, as
``aggregate`` over a literal sequence.  They are accurate to about 1e-13 (Student's
with more than 10,000 degrees of freedom to 1e-11) and meant for the one-row results of the tests, not for a column of a large table.

Conventions shared by all tests:

* the statistic is null when a group has fewer than 2 units or the standard
  error is 0;
* ``p_one_sided`` is the tail in the requested direction: Student's t for
  Welch tests, the normal for proportions; there is no floor;
* statistics and df are rounded to 6 places, p to 9 (last-digit noise differs
  between engines).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS, P_DIGITS = 6, 9
TERMS = 200

# Lanczos coefficients (g = 7, 9 terms) of the gamma function.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _steps(first: int, last: int) -> Column:
    return F.sequence(F.lit(first), F.lit(last))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (x + float(i))
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(total)


def gamma_sf(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x) for a > 0, x >= 0."""
    scale = F.exp(a * F.log(x) - x - log_gamma(a))

    def term(s, n):  # x^n / (a (a+1) ... (a+n))
        t = s["t"] * x / (a + n)
        return F.struct(t.alias("t"), (s["sum"] + t).alias("sum"))

    start = F.struct((1.0 / a).alias("t"), (1.0 / a).alias("sum"))
    series = 1.0 - scale * F.aggregate(_steps(1, TERMS), start, term, lambda s: s["sum"])

    def level(s, n):  # the continued fraction from its last level up
        k = (F.lit(TERMS + 1) - n).cast("double")
        return x + 2.0 * k + 1.0 - a - (k + 1.0) * (k + 1.0 - a) / s

    deep = F.aggregate(_steps(1, TERMS + 1), x + 2.0 * (TERMS + 1) + 1.0 - a, level)
    return F.when(x <= 0, 1.0).when(x < a + 1.0, series).otherwise(scale / deep)


def beta_sf(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for 0 <= x <= 1."""
    def fraction(a, b, x):
        def level(s, n):  # 1 + d_m / (...), from the last level up; even and odd coefficients
            m = (F.lit(TERMS) - n).cast("double")
            half = F.floor((m + 1.0) / 2.0)
            even = half * (b - half) * x / ((a + 2.0 * half - 1.0) * (a + 2.0 * half))
            h = F.floor(m / 2.0)
            odd = -(a + h) * (a + b + h) * x / ((a + 2.0 * h) * (a + 2.0 * h + 1.0))
            return 1.0 + F.when(m % 2.0 == 0.0, odd).otherwise(even) / s

        deep = F.aggregate(_steps(0, TERMS), F.lit(1.0), level)
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
        return front / (a * deep)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1.0) / (a + b + 2.0), fraction(a, b, x)).otherwise(1.0 - fraction(b, a, 1.0 - x))


def normal_sf(z: Column) -> Column:
    """Upper tail P(Z > z) of the standard normal."""
    half = 0.5 * gamma_sf(F.lit(0.5), z * z / 2.0)
    return F.when(z >= 0, half).otherwise(1.0 - half)


#: Degrees of freedom beyond which Student's tail is the normal one with Fisher's corrections (next term below 1e-11).
MANY = 10_000.0


def student_sf(t: Column, df: Column) -> Column:
    """Upper tail P(T > t) of Student's t with ``df`` (not always whole) degrees of freedom."""
    half = 0.5 * beta_sf(df / 2.0, F.lit(0.5), df / (df + t * t))
    exact = F.when(t >= 0, half).otherwise(1.0 - half)
    t2 = t * t
    density = F.exp(-t2 / 2.0) / math.sqrt(2 * math.pi)
    near = normal_sf(t) + density * t * ((t2 + 1.0) / (4.0 * df) + (((3.0 * t2 - 7.0) * t2 - 5.0) * t2 - 3.0) / (96.0 * df * df))
    return F.when(df > MANY, F.greatest(near, F.lit(0.0))).otherwise(exact)


def _towards(stat: Column, direction: str) -> Column:
    if direction not in ("greater", "less"):
        raise ValueError("direction must be 'greater' or 'less'")
    return stat if direction == "greater" else -stat


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column,
          direction: str) -> dict[str, Column]:
    """Welch's unequal-variance t for mean1 - mean2: t, df and one-sided p."""
    a = v1 / n1
    b = v2 / n2
    se = F.sqrt(a + b)
    ok = (n1 >= 2) & (n2 >= 2) & (se > 0)
    t = F.when(ok, (m1 - m2) / se)
    df = F.when(ok, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))
    p = F.when(ok, student_sf(_towards(t, direction), df))
    return {"t": F.round(t, DIGITS), "df": F.round(df, DIGITS), "p_one_sided": F.round(p, P_DIGITS)}


def two_proportion(x1: Column, n1: Column, x2: Column, n2: Column,
                   direction: str) -> dict[str, Column]:
    """Pooled two-proportion z for rate1 - rate2 and its one-sided p."""
    n1d, n2d = n1.cast("double"), n2.cast("double")
    pooled = (x1 + x2).cast("double") / (n1d + n2d)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n1d + F.lit(1.0) / n2d))
    ok = (n1 >= 2) & (n2 >= 2) & (se > 0)
    z = F.when(ok, (x1.cast("double") / n1d - x2.cast("double") / n2d) / se)
    return {"z": F.round(z, DIGITS), "p_one_sided": F.round(F.when(ok, normal_sf(_towards(z, direction))), P_DIGITS)}


def chi2_sf(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution; null when dof < 1."""
    p = F.when((dof >= 1) & stat.isNotNull(), gamma_sf(dof.cast("double") / 2.0, stat / 2.0))
    return F.round(p, P_DIGITS)


#: Degrees of freedom beyond which the chi-square tail is taken from Wilson and Hilferty's cube root.
MANY_CELLS = 2_000


def chi2_tail(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution for any number of degrees of freedom, as many as there are sellers."""
    k = dof.cast("double")
    small = gamma_sf(F.least(k, F.lit(float(MANY_CELLS))) / 2.0, stat / 2.0)
    z = (F.pow(stat / k, F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * k))) / F.sqrt(2.0 / (9.0 * k))
    return F.when(k > MANY_CELLS, normal_sf(z)).otherwise(small)


def one_sample_proportion_z(x: Column, n: Column, p0: Column) -> Column:
    """z of an observed rate x/n against a reference rate p0."""
    nd = n.cast("double")
    se = F.sqrt(p0 * (F.lit(1.0) - p0) / nd)
    return F.round(F.when((n >= 2) & (se > 0), (x.cast("double") / nd - p0) / se), DIGITS)


def with_total(df, col: str, name: str):
    """``df`` plus a column ``name`` = sum of ``col`` over all rows.

    The total is a one-row aggregate (partial sums per task, then one row)
    applied as an uncorrelated scalar subquery: no join, and no whole-table
    window that would move every row into a single task.
    """
    from pyspark.sql import functions as F

    return df.withColumn(name, df.agg(F.sum(col)).scalar())


def ratio(num: Column, den: Column) -> Column:
    """num / den in doubles; null when den is 0 or null (never raises in ANSI mode)."""
    return F.try_divide(num.cast("double"), den.cast("double"))
