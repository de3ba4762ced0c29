"""Joins on named keys, safe when both sides come from the same data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_col(name: str) -> Column:
    return F.col(f"_l.`{name}`")


def right_col(name: str) -> Column:
    return F.col(f"_r.`{name}`")


def match(on: list[str], null_safe: bool = True) -> Column:
    tests = [
        left_col(k).eqNullSafe(right_col(k)) if null_safe else left_col(k) == right_col(k) for k in on
    ]
    return reduce(lambda a, b: a & b, tests)


def paired(left: DataFrame, right: DataFrame, on: list[str], how: str, null_safe: bool = True) -> DataFrame:
    """Joined rows with the sides addressed by left_col / right_col."""
    return left.alias("_l").join(right.alias("_r"), match(on, null_safe), how)


def attach(
    left: DataFrame, right: DataFrame, on: list[str], cols: list[str] | None = None,
    how: str = "left", null_safe: bool = True,
) -> DataFrame:
    """Columns of `right` beside every row of `left`."""
    cols = cols if cols is not None else [c for c in right.columns if c not in on]
    right = right.select(*on, *cols)
    return paired(left, right, on, how, null_safe).select(
        *[left_col(c) for c in left.columns], *[right_col(c) for c in cols]
    )


def restrict(left: DataFrame, right: DataFrame, on: list[str], how: str, null_safe: bool = True) -> DataFrame:
    """Semi or anti join: rows of `left` alone."""
    return left.alias("_l").join(right.select(*on).alias("_r"), match(on, null_safe), how)
