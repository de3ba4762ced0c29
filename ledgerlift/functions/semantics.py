"""Missing-value rules of the source language as column expressions.

A missing number is smaller than every number and equal to itself; a blank
string is missing and trailing blanks do not count in comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def lt(a, b) -> Column:
    a, b = _col(a), _col(b)
    return (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))


def le(a, b) -> Column:
    a, b = _col(a), _col(b)
    return a.isNull() | F.coalesce(a <= b, F.lit(False))


def gt(a, b) -> Column:
    return lt(b, a)


def ge(a, b) -> Column:
    return le(b, a)


def eq(a, b) -> Column:
    return _col(a).eqNullSafe(_col(b))


def is_blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def char_eq(a, b) -> Column:
    """Equality of strings with trailing blanks ignored and missing equal to blank."""
    a, b = _col(a), _col(b)
    return F.rtrim(F.coalesce(a, F.lit(""))) == F.rtrim(F.coalesce(b, F.lit("")))


def missing_to_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def clamp(c: Column, lo, hi) -> Column:
    """Clip to [lo, hi]; missing counts as below lo."""
    return F.when(lt(c, lo), F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)


# Currency amounts are summed as whole millionths, so totals do not depend on the order in
# which tasks finish. Millionths are cut at bit 20 to keep both running sums in a long.
_PART = 1 << 20


def millionths(c: Column) -> Column:
    """Amount in whole millionths, halves up."""
    return F.floor(c * 1000000.0 + 0.5)


def money_total(c: Column, over: WindowSpec | None = None) -> Column:
    """Exact sum of an amount as decimal(38,6), of a group or over a window."""
    whole = millionths(c)
    total = lambda part: F.sum(part) if over is None else F.sum(part).over(over)
    high = total(F.shiftright(whole, 20)).cast("decimal(20,0)") * F.lit(_PART).cast("decimal(8,0)")
    low = total(whole.bitwiseAND(F.lit(_PART - 1))).cast("decimal(20,0)")
    return ((high + low) * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(38,6)")


def money_sum(c: Column, digits: int = 2) -> Column:
    return F.round(money_total(c), digits).cast("double")
