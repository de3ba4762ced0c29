"""What the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words: runs of anything but space, tab, line feed, vertical tab, form feed and return.

    White space becomes one blank, so words are blanks-before-non-blanks; null text has none.
    """
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blank, " "), "")).cast("bigint")


def keep_others(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of the input that no output column replaces (a clash keeps the output's value)."""
    low = {c.lower() for c in taken}
    return [c for c in df.columns if c.lower() not in low]
