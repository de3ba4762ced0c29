"""Small helpers to state queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


def total(expr: str) -> str:
    """SQL of functions.semantics.money_total: exact sum of whole millionths."""
    return (f"(CAST(sum(CAST(floor({expr} * 1000000.0e0 + 0.5e0) AS BIGINT)) AS DECIMAL(30,0)) "
            f"* CAST(0.000001 AS DECIMAL(7,6)))")


def msum(expr: str, alias: str, digits: int = 2) -> str:
    """SQL of functions.semantics.money_sum."""
    return f"CAST(round({total(expr)}, {digits}) AS DOUBLE) AS {alias}"


def rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def col_list(names) -> str:
    return ", ".join(names)
