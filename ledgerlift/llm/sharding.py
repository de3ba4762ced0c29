"""Two-pass external shuffle into shards of equal row counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep_others, table


def shuffle_shards(
    df: DataFrame,
    shards: int = 16,
    seed: int = 20240,
    key: tuple[str, ...] = ("doc_id", "text"),
    text: str = "text",
    bucket_bytes: int = 32 << 20,
) -> DataFrame:
    """The whole rows of `df` in random order, cut into `shards` runs: adds shard and slot.

    Pass one scatters whole records into buckets of about `bucket_bytes` of text by a seeded
    hash of `key`; partition i of that shuffle is bucket i, so a task holds one bucket. Pass two
    shuffles each bucket's array (Spark's `shuffle` is a seeded Fisher-Yates exchange) and gives
    every record its place: the bucket's offset plus its index. Places are cut into runs whose
    lengths differ by one at most. Buckets are put in order of their records first, so a
    retried task and a rerun give the same places.

    The hash takes the document's id and text, so a hot source or language spreads; only rows
    that repeat both share a bucket. Null ids and texts hash like a value of their own, an empty
    table gives no rows, repeated rows each get a place, and input columns called shard or slot
    are replaced. Fewer rows than shards leave the last shards empty.
    """
    cols = keep_others(df, ["shard", "slot"])
    amount = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    total = df.agg(F.sum(amount)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int")

    # one row per bucket: a window over them is small next to one bucket
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = df.agg(F.count(F.lit(1))).first()[0]

    scattered = df.select(bucket.alias("_bucket"), F.struct(F.xxhash64(*key).alias("_order"), F.struct(*cols).alias("_row")).alias("_rec"))
    held = (
        scattered.repartitionById(buckets, F.col("_bucket"))
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list("_rec")).alias("_recs"))
    )
    mixed = held.select("_bucket", F.posexplode(F.shuffle("_recs", F.lit(seed))).alias("_at", "_rec"))
    placed = mixed.join(F.broadcast(offsets), "_bucket").withColumn("_place", F.col("_before") + F.col("_at"))
    low, longer = divmod(rows, shards)
    edge = longer * (low + 1)
    place = F.col("_place")
    in_long = place < edge
    return placed.select(
        "_rec._row.*",
        F.when(in_long, F.floor(place / (low + 1)))
        .otherwise(longer + F.floor((place - edge) / max(low, 1))).cast("int").alias("shard"),
        F.when(in_long, place % (low + 1)).otherwise((place - edge) % max(low, 1)).cast("bigint").alias("slot"),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Write the shuffled rows, a folder per shard. Buckets lie in one or two shards, so nothing moves again."""
    df.write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `rows`."""
    docs = table(spark, sf_dir, "documents")
    out = shuffle_shards(docs)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
