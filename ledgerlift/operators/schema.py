"""Source types to Spark types: mapping tables, casts, migration plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display formats that mark dates and datetimes, and the source's day zero.
DATE_FORMATS = ["date", "ddmmyy", "mmddyy", "yymmdd", "date9", "date7", "dateampm"]
DATETIME_FORMATS = ["datetime", "datetime20", "datetime18", "e8601dt", "dateampm"]
DAY_ZERO = "1960-01-01"
SECONDS_TO_1970 = 315619200


def _contains(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def map_types(columns: DataFrame, target: str = "lakehouse", strict_reference: bool = False) -> DataFrame:
    """Add target_type from type, format and length.

    Datetime formats are tested before date formats, whose names they contain; strict mode
    tests dates first, which turns most datetimes into dates, and fixes amounts at two
    decimals instead of reading the scale from the format.
    """
    kind, fmt = F.lower("type"), F.lower("format")
    stamp = "TIMESTAMP" if target == "lakehouse" else "TIMESTAMP_NTZ"
    date, datetime = (_contains(fmt, DATE_FORMATS), "DATE"), (_contains(fmt, DATETIME_FORMATS), stamp)
    first, second = (date, datetime) if strict_reference else (datetime, date)
    number = F.when(first[0], first[1]).when(second[0], second[1])
    if target == "lakehouse":
        places = F.coalesce(F.nullif(F.regexp_extract(fmt, r"\.(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
        scaled = F.when(places > 2, "DECIMAL(38,18)").otherwise(F.concat(F.lit("DECIMAL(20,"), places.cast("string"), F.lit(")")))
        amount = F.lit("DECIMAL(20,2)") if strict_reference else scaled
        number = number.when(_contains(fmt, ["commax", "dollar"]), amount).otherwise("DOUBLE")
        text = other = F.lit("STRING")
    else:
        number = number.otherwise("NUMBER(38,10)")
        width = F.when(F.col("length") > 0, F.col("length")).otherwise(256)
        text = F.concat(F.lit("VARCHAR("), width.cast("string"), F.lit(")"))
        other = F.lit("VARCHAR(256)")
    return columns.withColumn("target_type", F.when(kind == "num", number).when(kind == "char", text).otherwise(other))


def cast_value(c: Column, target_type: str, length: int = 0) -> Column:
    """Source number or text as its mapped type of either family; an unreadable value is missing.

    Dates count days, datetimes seconds, from 1960. A text is cut to its declared width, that of
    VARCHAR(n) if the metadata has none. An unknown type is an error.
    """
    kind, _, inside = target_type.upper().strip().rstrip(")").partition("(")
    if kind == "DATE":
        return F.date_add(F.lit(DAY_ZERO).cast("date"), c.try_cast("int"))
    if kind in ("TIMESTAMP", "TIMESTAMP_NTZ"):
        epoch = F.lit("1960-01-01 00:00:00").cast("timestamp_ntz")
        return epoch + F.make_dt_interval(secs=c.try_cast("decimal(18,6)"))
    if kind in ("DECIMAL", "NUMBER"):
        return c.try_cast(f"decimal({inside or '38,0'})")
    if kind in ("DOUBLE", "FLOAT"):
        return c.try_cast("double")
    if kind in ("STRING", "VARCHAR"):
        width = length or int(inside or 0)
        return F.substring(c.cast("string"), 1, width) if width else c.cast("string")
    raise ValueError(f"unknown target type {target_type}")


def apply_schema(df: DataFrame, columns: list[dict]) -> DataFrame:
    """Cast a raw table by its column metadata: lower-case names, labels as comments.

    `columns` holds name, target_type and optionally type, length and label.
    """
    out = []
    for col in columns:
        length = int(col.get("length") or 0) if col.get("type") == "char" else 0
        value = cast_value(F.col(col["name"]), col["target_type"], length)
        meta = {"comment": col["label"]} if col.get("label") else {}
        out.append(value.alias(col["name"].lower(), metadata=meta))
    return df.select(*out)


def migration_plan(datasets: DataFrame, columns: DataFrame, target: str = "lakehouse") -> DataFrame:
    """One row per dataset: rows, columns, columns per family of target type."""
    mapped = map_types(columns, target)
    of = lambda prefix: F.count(F.when(F.col("target_type").startswith(prefix), 1))
    per = mapped.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("n_columns"), of("DATE").alias("n_date"), of("TIMESTAMP").alias("n_timestamp"),
        of("DECIMAL").alias("n_decimal"), of("DOUBLE").alias("n_double"), of("STRING").alias("n_string"),
    )
    return datasets.select("dataset_name", "row_count").join(per, "dataset_name", "left")


def source_type(spark_type: str) -> tuple[str, str]:
    """Source type and display format that stand for a Spark type in column metadata."""
    if spark_type.startswith(("timestamp",)):
        return "num", "DATETIME20."
    if spark_type == "date":
        return "num", "DATE9."
    if spark_type.startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")):
        return "num", ""
    return "char", ""
