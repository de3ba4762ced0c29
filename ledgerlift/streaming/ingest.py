"""Incremental loading of a folder that keeps receiving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerlift.operators.reconcile import check_row_count


def incremental_ingest(
    spark: SparkSession, src_dir: str, table_dir: str, schema: str | StructType, checkpoint: str,
    sep: str = ",", max_files: int | None = None,
) -> StreamingQuery:
    """Append the rows of files not seen before and stop; the checkpoint remembers the files.

    The schema may gain columns from one run to the next; files that lack them give missing
    values. `max_files` bounds the files of one micro-batch, so that a first run over a full folder
    is cut into batches.
    """
    reader = spark.readStream.schema(schema).option("header", "true").option("sep", sep)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        reader.csv(src_dir)
        .writeStream.format("parquet")
        .option("path", table_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest(spark: SparkSession, src_dir: str, table_dir: str, schema, checkpoint: str, **options) -> DataFrame:
    """Run an ingest to its end and return the table, with the columns of every run so far."""
    incremental_ingest(spark, src_dir, table_dir, schema, checkpoint, **options).awaitTermination()
    return spark.read.option("mergeSchema", "true").parquet(table_dir)


def stream_then_reconcile(
    spark: SparkSession, src_dir: str, table_dir: str, schema, checkpoint: str, source: DataFrame, name: str
) -> DataFrame:
    """Ingest what is new and check the table's row count against the source."""
    return check_row_count(source, ingest(spark, src_dir, table_dir, schema, checkpoint), name)
