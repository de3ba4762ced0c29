"""Checks after a load, each giving rows (dataset, check, column, expected, actual, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _verdict(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def _row(name: str, check: str, column: Column, expected: Column, actual: Column) -> list[Column]:
    return [
        F.lit(name).alias("dataset"), F.lit(check).alias("check"), column.alias("column"),
        expected.cast("double").alias("expected"), actual.cast("double").alias("actual"),
        _verdict(expected.eqNullSafe(actual)).alias("status"),
    ]


def check_row_count(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    return count(target).select(*_row(name, "row_count", F.lit(""), count(source).scalar(), F.col("n")))


def check_expected_count(target: DataFrame, expected: int, name: str) -> DataFrame:
    """Row count against the number the source's metadata states."""
    return target.agg(F.count(F.lit(1)).alias("n")).select(
        *_row(name, "row_count", F.lit(""), F.lit(expected).cast("bigint"), F.col("n"))
    )


def check_schema(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """Column count of both sides, and a row for every column missing, extra or of another type.

    Reads the two plans' schemas; no data is touched.
    """
    spark = source.sparkSession
    want = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    have = {f.name: f.dataType.simpleString() for f in target.schema.fields}
    rows = [(name, "schema", "", float(len(want)), float(len(have)), "PASS" if len(want) == len(have) else "FAIL")]
    for c in sorted({*want, *have}):
        if c not in have:
            rows.append((name, "schema_missing", c, 1.0, 0.0, "FAIL"))
        elif c not in want:
            rows.append((name, "schema_extra", c, 0.0, 1.0, "FAIL"))
        elif want[c] != have[c]:
            rows.append((name, "schema_type", c, 1.0, 1.0, "FAIL"))
    return spark.createDataFrame(
        rows, "dataset string, check string, column string, expected double, actual double, status string"
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString().startswith(NUMERIC)]


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column and measure from a single pass."""
    measures = {
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "avg": lambda c: F.round(F.avg(c), 6).cast("double"),
        "null_count": lambda c: (F.count(F.lit(1)) - F.count(c)).cast("double"),
    }
    wide = df.agg(*[f(F.col(c)).alias(f"{c}__{m}") for c in columns for m, f in measures.items()])
    rows = [
        F.struct(F.lit(m).alias("measure"), F.lit(c).alias("column"), F.col(f"{c}__{m}").alias("value"))
        for c in columns for m in measures
    ]
    return wide.select(F.inline(F.array(*rows)))


def check_column_stats(source: DataFrame, target: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Smallest, largest, mean and missing count of every shared numeric column."""
    columns = columns or [c for c in numeric_columns(source) if c in target.columns]
    want = column_stats(source, columns).withColumnRenamed("value", "expected")
    have = column_stats(target, columns).withColumnRenamed("value", "actual")
    return want.join(have, ["measure", "column"]).select(
        F.lit(name).alias("dataset"), F.col("measure").alias("check"), "column", "expected", "actual",
        _verdict(F.col("expected").eqNullSafe(F.col("actual"))).alias("status"),
    )


def checksum(df: DataFrame) -> DataFrame:
    """Order-free hash of a table; the sum tells duplicated rows apart, which the xor cancels."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(20,0)")).alias("sum_hash"))


def check_checksum(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    text = lambda df: checksum(df).select(F.concat_ws("/", "xor_hash", "sum_hash").alias("h"))
    return text(target).select(
        F.lit(name).alias("dataset"), F.lit("checksum").alias("check"), F.lit("").alias("column"),
        F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("actual"),
        _verdict(F.col("h") == text(source).scalar()).alias("status"),
    )


def check_exists(spark: SparkSession, table: str) -> DataFrame:
    """One row telling whether a named table or view exists."""
    there = spark.catalog.tableExists(table)
    return spark.range(1).select(
        F.lit(table).alias("dataset"), F.lit("exists").alias("check"), F.lit("").alias("column"),
        F.lit(1.0).alias("expected"), F.lit(float(there)).alias("actual"),
        F.lit("PASS" if there else "WARNING").alias("status"),
    )


# --- whole libraries at once, from their metadata ------------------------------------------------


def check_schemas(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns of every dataset of two libraries, given as rows (dataset_name, name, type): counts, and what is missing, extra or of another type.

    Names are compared without case. A dataset that one side lacks has a count of 0 there. One join of the
    column tables answers all datasets; nothing is looped over.
    """
    side = lambda df, mark: df.select(F.col("dataset_name").alias("dataset"), F.lower("name").alias("key"), F.col("name").alias(f"{mark}_name"),
                                      F.col("type").alias(f"{mark}_type"))
    both = side(expected, "want").join(side(actual, "have"), ["dataset", "key"], "full")
    missing, extra = F.col("have_name").isNull(), F.col("want_name").isNull()
    other = ~missing & ~extra & ~F.col("want_type").eqNullSafe(F.col("have_type"))
    number = lambda present: present.cast("int").cast("double")
    found = both.where(missing | extra | other).select(
        "dataset", F.when(missing, "schema_missing").when(extra, "schema_extra").otherwise("schema_type").alias("check"),
        F.coalesce("want_name", "have_name").alias("column"), number(~extra).alias("expected"), number(~missing).alias("actual"),
        F.lit("FAIL").alias("status"),
    )
    counted = both.groupBy("dataset").agg(F.count("want_name").cast("double").alias("expected"), F.count("have_name").cast("double").alias("actual"))
    counts = counted.select(
        "dataset", F.lit("schema").alias("check"), F.lit("").alias("column"), "expected", "actual",
        _verdict(F.col("expected") == F.col("actual")).alias("status"),
    )
    return counts.unionByName(found)


def check_row_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Row counts of every dataset of the first library, both given as (dataset_name, row_count), against the second.

    An unknown expected count (null or negative) gives status UNKNOWN; a dataset the second lacks fails.
    """
    want = expected.select(F.col("dataset_name").alias("dataset"), F.col("row_count").cast("double").alias("expected"))
    have = actual.select(F.col("dataset_name").alias("dataset"), F.col("row_count").cast("double").alias("actual"))
    known = F.coalesce(F.col("expected") >= 0, F.lit(False))
    return want.join(have, "dataset", "left").select(
        "dataset", F.lit("row_count").alias("check"), F.lit("").alias("column"), F.when(known, F.col("expected")).alias("expected"), "actual",
        F.when(~known, "UNKNOWN").otherwise(_verdict(F.col("expected").eqNullSafe(F.col("actual")))).alias("status"),
    )


def check_tables(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row for every dataset_name of the first library: PASS if the second has it, else WARNING."""
    there = actual.select(F.col("dataset_name").alias("dataset"), F.lit(1.0).alias("_there")).distinct()
    found = F.coalesce("_there", F.lit(0.0))
    return expected.select(F.col("dataset_name").alias("dataset")).distinct().join(there, "dataset", "left").select(
        "dataset", F.lit("exists").alias("check"), F.lit("").alias("column"), F.lit(1.0).alias("expected"), found.alias("actual"),
        F.when(found == 1.0, "PASS").otherwise("WARNING").alias("status"),
    )


def reconcile_library(
    datasets: DataFrame, columns: DataFrame, loaded_datasets: DataFrame, loaded_columns: DataFrame
) -> DataFrame:
    """Existence, row counts and columns of a whole library against what was loaded, from the metadata of both."""
    return (
        check_tables(datasets, loaded_datasets)
        .unionByName(check_row_counts(datasets, loaded_datasets))
        .unionByName(check_schemas(columns, loaded_columns))
    )


def reconcile(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """Every check of one pair of tables as one result."""
    checks = [
        check_row_count(source, target, name),
        check_schema(source, target, name),
        check_column_stats(source, target, name),
        check_checksum(source.select(*[c for c in source.columns if c in target.columns]),
                       target.select(*[c for c in source.columns if c in target.columns]), name),
    ]
    return reduce(lambda a, b: a.unionByName(b), checks)
