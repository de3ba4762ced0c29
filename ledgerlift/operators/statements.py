"""Statements for a target platform as rows: tables, loads, and the checks after a load.

One row per dataset and statement, built from the metadata tables: a dataset's columns meet by a
shuffle on its name, and nothing passes the driver. Two families of targets are known, `lakehouse` and
`warehouse`; they differ in types, quoting and in how files are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.schema import map_types

PLAIN_NAME = "^[A-Za-z_][A-Za-z0-9_]*$"


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def quoted_name(name: Column, target: str) -> Column:
    """A name as the target writes it; one that is not plain is quoted."""
    mark = "`" if target == "lakehouse" else '"'
    inside = _replace(name, [(mark, mark * 2)])
    return F.when(name.rlike(PLAIN_NAME), name).otherwise(F.concat(F.lit(mark), inside, F.lit(mark)))


def quoted_text(text: Column, target: str) -> Column:
    """A text literal; quotes inside are escaped as the target does."""
    inside = _replace(text, [("\\", "\\\\"), ("'", "\\'")] if target == "lakehouse" else [("'", "''")])
    return F.concat(F.lit("'"), inside, F.lit("'"))


def _cased(name: Column, target: str) -> Column:
    return F.lower(name) if target == "lakehouse" else F.upper(name)


def table_name(dataset: Column, target: str, namespace: str) -> Column:
    return F.concat(F.lit(f"{namespace}."), quoted_name(_cased(dataset, target), target))


def _columns_of(columns: DataFrame, target: str) -> DataFrame:
    """(dataset_name, cols): a dataset's columns in order, with their names and types in the target."""
    mapped = map_types(columns, target)
    name = quoted_name(_cased(F.col("name"), target), target)
    col = F.struct("position", "name", name.alias("target_name"), "target_type", "type", "label")
    return mapped.groupBy("dataset_name").agg(F.sort_array(F.collect_list(col)).alias("cols"))


def _with_columns(datasets: DataFrame, columns: DataFrame, target: str) -> DataFrame:
    none = F.array().cast(_columns_of(columns, target).schema["cols"].dataType)
    joined = datasets.join(_columns_of(columns, target), "dataset_name", "left")
    return joined.withColumn("cols", F.coalesce("cols", none))


def create_statements(
    datasets: DataFrame, columns: DataFrame, target: str = "lakehouse", namespace: str = "bronze", provider: str | None = None
) -> DataFrame:
    """(dataset_name, kind, statement): the table of every dataset, types mapped, labels as comments.

    `provider` names the lakehouse's table format. A dataset without known columns has no statement.
    """
    def line(c: Column) -> Column:
        label = F.coalesce(c["label"], F.lit(""))
        note = F.when(label == "", "").otherwise(F.concat(F.lit(" COMMENT "), quoted_text(label, target)))
        return F.concat(F.lit("  "), c["target_name"], F.lit(" "), c["target_type"], note)

    lines = F.array_join(F.transform("cols", line), ",\n")
    tail = f"\n)\nUSING {provider}" if provider and target == "lakehouse" else "\n)"
    text = F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), table_name(F.col("dataset_name"), target, namespace), F.lit(" (\n"), lines, F.lit(tail))
    return _with_columns(datasets, columns, target).select(
        "dataset_name", F.lit("create").alias("kind"), F.when(F.size("cols") > 0, text).alias("statement")
    )


def load_statements(
    datasets: DataFrame, target: str = "lakehouse", namespace: str = "bronze", location: str = "/landing", recurring: bool = False
) -> DataFrame:
    """(dataset_name, kind, statement): the load of every dataset's CSV file, or of the files that keep coming into its folder."""
    name, table = F.col("dataset_name"), table_name(F.col("dataset_name"), target, namespace)
    if target == "lakehouse":
        folder = quoted_text(F.concat(F.lit(f"{location}/"), name, F.lit("/" if recurring else ".csv")), target)
        if recurring:
            text = F.concat(
                F.lit("CREATE OR REFRESH STREAMING TABLE "), table, F.lit("\nAS SELECT * FROM STREAM read_files("), folder,
                F.lit(", format => 'csv', header => true)"),
            )
        else:
            text = F.concat(
                F.lit("COPY INTO "), table, F.lit("\nFROM "), folder,
                F.lit("\nFILEFORMAT = CSV\nFORMAT_OPTIONS ('header' = 'true', 'inferSchema' = 'true', 'delimiter' = ',')\n"
                      "COPY_OPTIONS ('mergeSchema' = 'true')"),
            )
    else:
        source = F.concat(F.lit(f"@{location.strip('/')}/"), name, F.lit("/" if recurring else ".csv"))
        read = F.lit("\nFILE_FORMAT = (TYPE = 'CSV' SKIP_HEADER = 1 FIELD_OPTIONALLY_ENCLOSED_BY = '\"')")
        copy = F.concat(F.lit("COPY INTO "), table, F.lit("\nFROM "), source, read)
        pipe = F.concat(F.lit(f"{namespace}."), quoted_name(F.concat(F.lit("PIPE_"), F.upper(name)), target))
        text = (
            F.concat(F.lit("CREATE OR REPLACE PIPE "), pipe, F.lit("\nAUTO_INGEST = TRUE\nAS "), copy)
            if recurring else F.concat(copy, F.lit("\nON_ERROR = 'CONTINUE'"))
        )
    return datasets.select("dataset_name", F.lit("load_recurring" if recurring else "load").alias("kind"), text.alias("statement"))


def check_statements(datasets: DataFrame, columns: DataFrame, target: str = "lakehouse", namespace: str = "bronze") -> DataFrame:
    """(dataset_name, kind, statement): row count, number of columns, statistics and checksum of every loaded table.

    Statistics of all numeric columns (dates have no mean) are one statement that reads the table once. A dataset whose row
    count is unknown (null or negative) is counted without a verdict; one without numeric columns has no statistics.
    """
    known = _with_columns(datasets, columns, target)
    name, table = F.col("dataset_name"), table_name(F.col("dataset_name"), target, namespace)
    label = quoted_text(name, target)

    def verdict(kind: str, expected: Column, unknown: Column, source: Column) -> Column:
        number = F.when(unknown, "NULL").otherwise(expected.cast("string"))
        passed = F.concat(F.lit("CASE WHEN count(*) = "), number, F.lit(" THEN 'PASS' ELSE 'FAIL' END"))
        return F.concat(
            F.lit("SELECT "), label, F.lit(f" AS dataset, '{kind}' AS check_name, "), number,
            F.lit(" AS expected, count(*) AS actual, "), F.when(unknown, "'UNKNOWN'").otherwise(passed), F.lit(" AS status FROM "), source,
        )

    rows = F.coalesce(F.col("row_count"), F.lit(-1))
    schema_of = F.concat(
        F.lit("information_schema.columns WHERE lower(table_schema) = "), quoted_text(F.lit(namespace.rpartition(".")[2].lower()), target),
        F.lit(" AND lower(table_name) = "), quoted_text(F.lower(name), target),
    )
    if "." in namespace:
        schema_of = F.concat(F.lit(namespace.partition(".")[0] + "."), schema_of)
    numeric = F.filter("cols", lambda c: c["type"] == "num")

    def stats(c: Column) -> Column:
        n = c["target_name"]
        bare = F.regexp_replace(n, '[`"]', "")
        as_name = lambda prefix: quoted_name(F.concat(F.lit(prefix), bare), target)
        mean = F.concat(F.lit(", avg("), n, F.lit(") AS "), as_name("avg_"))
        return F.concat(
            F.lit("min("), n, F.lit(") AS "), as_name("min_"), F.lit(", max("), n, F.lit(") AS "), as_name("max_"),
            F.when(c["target_type"].rlike("^(DATE|TIMESTAMP)"), "").otherwise(mean),
            F.lit(", count(*) - count("), n, F.lit(") AS "), as_name("nulls_"),
        )

    all_names = F.array_join(F.transform("cols", lambda c: c["target_name"]), ", ")
    hashed = F.concat(F.lit("bit_xor(xxhash64("), all_names, F.lit("))")) if target == "lakehouse" else F.lit("hash_agg(*)")
    texts = {
        "row_count": verdict("row_count", rows, rows < 0, table),
        "schema": verdict("schema", F.size("cols"), F.size("cols") == 0, schema_of),
        "column_stats": F.when(F.size(numeric) > 0, F.concat(
            F.lit("SELECT "), label, F.lit(" AS dataset, "), F.array_join(F.transform(numeric, stats), ", "), F.lit(" FROM "), table)),
        "checksum": F.when(F.size("cols") > 0, F.concat(
            F.lit("SELECT "), label, F.lit(" AS dataset, "), hashed, F.lit(" AS checksum FROM "), table)),
    }
    each = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("statement")) for k, t in texts.items()])
    return known.select("dataset_name", F.inline(each)).where(F.col("statement").isNotNull())


def write_statements(statements: DataFrame, path: str) -> None:
    """Write the statements as text, a folder per kind, each closed by a semicolon and an empty line."""
    text = F.concat("statement", F.lit(";\n"))
    statements.where(F.col("statement").isNotNull()).select("kind", text.alias("value")).write.partitionBy("kind").text(path)
