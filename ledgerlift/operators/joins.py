"""Lookups and BY-merges. Broadcasting is left to the size checks of the optimiser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.keys import attach, left_col, paired, restrict, right_col
from ledgerlift.operators.ordering import row_numbers


def lookup_join(
    df: DataFrame, ref: DataFrame, on: list[str], cols: list[str] | None = None,
    how: str = "left", null_safe: bool = True,
) -> DataFrame:
    """Attach columns of `ref`. Missing keys match missing keys unless null_safe is off."""
    return attach(df, ref, on, cols, how, null_safe)


def hash_lookup(
    df: DataFrame, ref: DataFrame, key: list[str], data: list[str], on_miss: str = "drop"
) -> DataFrame:
    """Keyed lookup; rows whose key is absent are dropped or get missing values.

    The table keeps one row per key: the smallest by its data columns.
    """
    value = F.struct(*data)
    table = ref.groupBy(*key).agg(F.min(value).alias("_v")).select(*key, "_v.*")
    return attach(df, table, key, data, "inner" if on_miss == "drop" else "left")


def apply_format(df: DataFrame, labels: DataFrame, col: str, into: str) -> DataFrame:
    """Label of a code by lookup; codes without a label show themselves.

    `labels` has the columns code and label, one row per code.
    """
    named = labels.select(F.col("code").alias(col), F.col("label").alias("_label"))
    return attach(df, named, [col]).select(
        *df.columns, F.coalesce("_label", F.col(col).cast("string")).alias(into)
    )


def range_format(c: Column, ranges: list[tuple[float | None, float | None, str]], other: str | None = None) -> Column:
    """Label of the interval lo <= value < hi; None leaves an end open."""
    out = None
    for lo, hi, label in ranges:
        test = F.lit(True)
        if lo is not None:
            test = test & (c >= lo)
        if hi is not None:
            test = test & (c < hi)
        out = F.when(test & c.isNotNull(), F.lit(label)) if out is None else out.when(test & c.isNotNull(), F.lit(label))
    return out.otherwise(F.lit(other))


def unmatched(a: DataFrame, b: DataFrame, on: list[str], null_safe: bool = True) -> DataFrame:
    return restrict(a, b, on, "left_anti", null_safe)


def having_marker(a: DataFrame, b: DataFrame, on: list[str], null_safe: bool = True) -> DataFrame:
    return restrict(a, b, on, "left_semi", null_safe)


def _subset(df: DataFrame, keep: str) -> DataFrame:
    tests = {"a": "in_a", "b": "in_b", "ab": "in_a and in_b", "any": "true"}
    return df.where(tests[keep])


def merge_by(
    left: DataFrame, right: DataFrame, by: list[str], keep: str = "any",
    order: tuple[list[str], list[str]] | None = None,
) -> DataFrame:
    """MERGE ... BY with presence flags in_a / in_b.

    Without `order` the right side has one row per key, else the job fails; it describes the key, so its
    shared columns win on every row of the key. With `order` (unique row orders of both sides)
    rows of a key are paired by position and the shorter side repeats its last row, as the source
    language does: a shared column then comes from the side read last for that row.

    Right rows without a left row are an anti join put below the left join, never a full or right
    join, so that a hot key of the left side can be split.
    """
    shared = [c for c in left.columns if c in right.columns and c not in by]
    only_a = [c for c in left.columns if c not in by and c not in shared]
    only_b = [c for c in right.columns if c not in by and c not in shared]
    l, r = left_col, right_col
    if order is None:
        rest = [c for c in right.columns if c not in by]
        many = F.raise_error(F.lit("the right side has several rows of one key"))
        packed = right.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(F.lit(1).alias("_one"), *rest)).alias("_v"))
        single = packed.select(*by, F.when(F.col("_n") > 1, many.cast(packed.schema["_v"].dataType)).otherwise(F.col("_v")).alias("_v"))

        def rows(df: DataFrame, in_a: bool, value: Column) -> DataFrame:
            met = value.isNotNull()
            return df.select(
                *by, *[(F.col(c) if in_a else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in only_a],
                *[(F.when(met, value[c]).otherwise(F.col(c)) if in_a else value[c]).alias(c) for c in shared],
                *[value[c].alias(c) for c in only_b], F.lit(in_a).alias("in_a"), met.alias("in_b"),
            )

        out = rows(attach(left, single, by, ["_v"], "inner" if keep in ("ab", "b") else "left"), True, F.col("_v"))
        if keep in ("any", "b"):
            out = out.unionByName(rows(restrict(single, left, by, "left_anti"), False, F.col("_v")))
        return out

    def side(df: DataFrame, row_order: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
        rest = [c for c in df.columns if c not in by]
        numbered = row_numbers(df, by, row_order, "_i")
        packed = numbered.select(*by, "_i", F.struct(*rest).alias(f"_{tag}"))
        end = packed.groupBy(*by).agg(F.max_by(f"_{tag}", "_i").alias(f"_last_{tag}"))
        return packed, end

    a, last_a = side(left, order[0], "a")
    b, last_b = side(right, order[1], "b")
    pairs = paired(a, b, [*by, "_i"], "full").select(
        *[F.when(l("_i").isNotNull(), l(k)).otherwise(r(k)).alias(k) for k in by], l("_a"), r("_b")
    )
    pairs = attach(attach(pairs, last_a, by), last_b, by)
    now_a = F.coalesce(F.col("_a"), F.col("_last_a"))
    now_b = F.coalesce(F.col("_b"), F.col("_last_b"))
    out = pairs.select(
        *by,
        *[now_a[c].alias(c) for c in only_a],
        *[
            F.when(F.col("_b").isNotNull(), F.col("_b")[c]).otherwise(F.col("_a")[c]).alias(c)
            for c in shared
        ],
        *[now_b[c].alias(c) for c in only_b],
        F.col("_last_a").isNotNull().alias("in_a"),
        F.col("_last_b").isNotNull().alias("in_b"),
    )
    return _subset(out, keep)
