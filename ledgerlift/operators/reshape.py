"""Set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.keys import restrict


def concat_set(*dfs: DataFrame) -> DataFrame:
    """SET a b c: rows of all inputs by column name, absent columns missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_all(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by position."""
    return reduce(lambda a, b: a.union(b), dfs)


def unpivot(df: DataFrame, ids: list[str], values: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide to long in one pass; `values` maps column -> label."""
    renamed = df.select(*ids, *[F.col(c).alias(label) for c, label in values.items()])
    return renamed.unpivot(ids, list(values.values()), name, value)


def split_outputs(df: DataFrame, outputs: dict[str, Column], label: str = "output") -> DataFrame:
    """Rows tagged with every output they belong to; one scan serves all outputs.

    Write with partitionBy(label) to get one folder per output.
    """
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in outputs.items()]))
    return df.withColumn(label, F.explode(tags))


def set_diff(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Distinct values of `a` that `b` lacks."""
    return restrict(a.select(*on).distinct(), b, on, "left_anti")


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def coverage_gaps(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Per entity, how many of the values that any entity has it lacks: (entity, n_missing, n_known).

    Counts alone: one row per entity, whatever the number of values; an entity that lacks nothing
    yields no row. `coverage_universe` lists the values, `missing_values` names those of one entity.
    """
    pairs = df.where(F.col(value).isNotNull())
    known = pairs.agg(F.count_distinct(value)).scalar()
    held = pairs.groupBy(entity).agg(F.count_distinct(value).alias("_held"))
    lacking = (known - F.col("_held")).alias("n_missing")
    return held.select(entity, lacking, known.alias("n_known")).where("n_missing > 0")


def coverage_universe(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Every value with the number of entities that have it."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(entity).alias("n_entities"))


def missing_values(df: DataFrame, entity: str, value: str, of) -> DataFrame:
    """The known values that the entity named `of` lacks."""
    known = df.select(value).where(F.col(value).isNotNull()).distinct()
    return restrict(known, df.where(F.col(entity).eqNullSafe(F.lit(of))).select(value), [value], "left_anti")
