"""Calendar helpers: period truncation and gap-free period spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = {"month": 1, "quarter": 3, "year": 12}


def period_start(ts: Column, grain: str = "month") -> Column:
    """First day of the ``grain`` period containing ``ts``, as a date."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {sorted(GRAINS)}")
    return F.trunc(F.to_date(ts), grain)


def add_periods(d: Column, k: int, grain: str = "month") -> Column:
    """``d`` moved by ``k`` periods of ``grain``."""
    return F.add_months(d, k * GRAINS[grain])


def period_spine(bounds: DataFrame, lo: str, hi: str, grain: str = "month",
                 name: str = "period", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per period from ``lo`` to ``hi`` (columns of a one-row frame).

    The input is a one-row aggregate, so the spine has as many rows as
    periods in the calendar span (tens to hundreds), independent of data size.
    Columns named in ``keep`` are carried from the one-row frame to every row.
    """
    step = F.expr(f"make_ym_interval(0, {GRAINS[grain]})")
    return bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi), step)).alias(name), *keep)
