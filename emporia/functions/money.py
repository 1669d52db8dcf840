"""Exact sums of money.

Money columns are decimals.  Spark sums ``decimal(p, s)`` into a buffer of
``p + 10`` digits, which above 18 digits is a ``java.math.BigDecimal`` per
update.  Where the unscaled value of a column and the multiplication that
yields it fit 18 digits, the unscaled longs are summed instead (ANSI mode
raises on overflow) and the total is scaled back by an exact decimal literal;
wider columns use Spark's decimal sum.  Both are exact.  Binary floating-point
columns are refused: round them to a stated scale first (``as_money``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def money_of(df: DataFrame, col: str) -> T.DecimalType:
    """The decimal type of a money column (integral columns count as scale 0)."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.DecimalType):
        return kind
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.DecimalType(19, 0)
    raise TypeError(f"money column {col!r} is {kind.simpleString()}: convert it with as_money(column, scale)")


def as_money(value: Column, scale: int = 2) -> Column:
    """A floating-point amount rounded half up to ``scale`` digits, as a decimal."""
    return F.round(value.cast(f"decimal(38,{min(scale + 6, 18)})"), scale).cast(f"decimal(18,{scale})")


def exact_sum(value: Column, kind: T.DecimalType) -> Column:
    """Sum of a decimal expression of type ``kind``, exact, as decimal(38, scale)."""
    out = f"decimal(38,{kind.scale})"
    if kind.scale == 0 or kind.precision + kind.scale + 2 > 18:
        return F.sum(value.cast(kind)).cast(out)
    unscaled = (value.cast(kind) * F.lit(Decimal(10) ** kind.scale)).cast("bigint")
    return (F.sum(unscaled).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-kind.scale))).cast(out)
