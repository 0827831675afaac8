"""Rounding, coercion and clipping as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, decimals: int) -> Column:
    """Round to decimals, ties to even, by way of rint (as numpy does)."""
    scale = F.lit(float(10**decimals))
    return F.rint(x * scale) / scale


def flag(x: Column) -> Column:
    """Text or number to an integer flag: empty or missing is 0, else the truncated number; unreadable is null."""
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit("0")).try_cast("double").cast("int")


def number(x: Column, default: float = 0.0) -> Column:
    """Numeric coercion: what cannot be read, NaN and null become the default."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def finite(x: Column) -> Column:
    """NaN, null and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
