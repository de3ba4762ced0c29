"""Ordered-group operators that never bring one whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.operators.keys import attach
from ledgerlift.session import cut, stored


#: Rows of a block of a running total.
BLOCK_ROWS = 2_000_000


def check_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Groups whose `order` does not tell their rows apart: keys, order and the number of rows; empty if all is well."""
    return df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: str, into: str) -> DataFrame:
    """Add `into`: the sum of `weight` up to and including the row, by `order` within `keys`.

    Rows are range-partitioned on (keys, order) into blocks of about BLOCK_ROWS rows, so a hot
    key is spread over as many blocks as it fills. Each block sums on its own; a block's offset is non-zero
    only for the key it shares with the block before, so there is at most one offset row
    per block and broadcasting them is bounded by the number of partitions.
    `order` must tell the rows of a key apart; `check_order` tells whether it does. The rows are
    written once to be counted, and so that sampling the ranges does not work them out again;
    the cut freezes the block numbers, which a recomputed range shuffle would not reproduce.
    """
    rows = stored(df, "ordered")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, -(-rows.count() // BLOCK_ROWS))
    ranged = cut(rows.repartitionByRange(blocks, *keys, *order).withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy("_block", *keys).orderBy(*order)
    local = ranged.withColumn(
        "_local", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    blocks = ranged.groupBy("_block", *keys).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.withColumn("_offset", F.sum("_sum").over(before))
        .where(F.col("_offset").isNotNull())
        .drop("_sum")
    )
    joined = attach(local, F.broadcast(offsets), ["_block", *keys], ["_offset"])
    total = (F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).alias(into)
    return joined.select(*df.columns, total)


def row_numbers(df: DataFrame, by: list[str], order: list[str], into: str = "row_no") -> DataFrame:
    """Number the rows of each group from 1; safe for groups of any size."""
    return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), by, order, "_one", into).drop("_one")


def percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], method: str = "cont"
) -> DataFrame:
    """Exact percentiles per group from distinct-value counts.

    method 'cont' interpolates between neighbours; 'averaged' takes the empirical
    distribution and averages at a jump (the statistical package's own default).
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_total(counts, keys, [value], "_n", "_upto")
    totals = ranked.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        joined = attach(ranked, totals, keys, how="inner")
    else:
        joined = ranked.withColumn("_total", totals.scalar())
    first, last = F.col("_upto") - F.col("_n") + 1, F.col("_upto")
    aggs = []
    for name, p in probs.items():
        if method == "cont":
            place = F.lit(float(p)) * (F.col("_total") - 1) + 1
            low, share = F.floor(place), place - F.floor(place)
            high = F.ceil(place)
        else:
            place = F.lit(float(p)) * F.col("_total")
            whole = F.floor(place)
            low = F.greatest(F.when(place == whole, whole).otherwise(whole + 1), F.lit(1))
            high = F.least(whole + 1, F.col("_total"))
            share = F.when(place == whole, F.lit(0.5)).otherwise(F.lit(0.0))
        at = lambda rank: F.max(F.when((first <= rank) & (rank <= last), F.col(value)))
        aggs += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"), F.max(share).alias(f"_s_{name}")]
    picked = joined.groupBy(*keys).agg(*aggs)
    outs = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_s_{n}")).alias(n)
        for n in probs
    ]
    return picked.select(*keys, *outs)


def nodupkey(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key. The rank filter prunes to one row per key before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_last(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add first_flag / last_flag (1 or 0) of each BY group; `order` must be unique in a group.

    The two ends come from a partial aggregate and are joined back, so no group is sorted
    in one task.
    """
    place = F.struct(*order)
    ends = df.groupBy(*by).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    here = F.struct(*order)
    return attach(df, ends, by, how="inner").select(
        *df.columns,
        (here == F.col("_first")).cast("int").alias("first_flag"),
        (here == F.col("_last")).cast("int").alias("last_flag"),
    )


def sort_by(df: DataFrame, by: list[str], descending: list[str] = ()) -> DataFrame:
    """Global sort with missing values first (last when descending)."""
    return df.orderBy(*[F.desc_nulls_last(c) if c in descending else F.asc_nulls_first(c) for c in by])


def top_k(df: DataFrame, score: str, k: int, tiebreak: list[str]) -> DataFrame:
    return df.orderBy(F.desc(score), *[F.asc(c) for c in tiebreak]).limit(k)


def rank_inventory(df: DataFrame, score: str, tiebreak: list[str]) -> DataFrame:
    """Every row with its place by score, best first; placed without one global task."""
    scored = df.withColumn("_neg", -F.col(score)).withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(scored, [], ["_neg", *tiebreak], "_one", "place").drop("_neg", "_one")


def attach_group_extreme(
    df: DataFrame, groups: DataFrame, on: list[str], how: str = "left"
) -> DataFrame:
    """Attach one aggregate row per group to every detail row; missing keys match missing keys."""
    return attach(df, groups, on, how=how)
