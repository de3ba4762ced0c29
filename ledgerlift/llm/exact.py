"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep_others, table
from ledgerlift.session import stored

#: A chunk's shortest and longest length in characters (the last of a text may be shorter).
LEAST, MOST = 512, 4096
#: A chunk ends behind one of these, the first after LEAST characters.
CUT = r"[a-g]\s|[.!?\x{3002}\x{0964}]"
OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text cut where its content says, so equal stretches fall into equal chunks wherever they stand.

    Joined they are the text; an empty text has none.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 2}}}?(?:{CUT}|\z)|.{{1,{most}}}"), F.lit(0))


def digest(chunk: Column, bits: int = 64) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def clashing(texts: DataFrame, bits: int) -> DataFrame:
    """(digest, chunk, variant): different chunks that share a digest, numbered within it; mostly no rows.

    Every chunk of every text is compared here, once: copies go before the shuffle, as whole chunks.
    """
    pieces = texts.select(F.explode(chunks(F.col("folded"))).alias("chunk"))
    different = pieces.select(digest(F.col("chunk"), bits).alias("digest"), "chunk").distinct()
    return different.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


def recipes(texts: DataFrame, bits: int) -> DataFrame:
    """(row, rest, text_sha256, recipe): the ordered chunk identifiers of every text.

    A chunk's identifier is its digest where all chunks of that digest are the same text, which is verified on
    the whole table. Otherwise it is the digest and the chunk's number among the different ones.
    """
    shared = stored(clashing(texts, bits), "clashing-digests")
    sha = F.sha2(F.col("folded"), 256).alias("text_sha256")
    if shared.isEmpty():
        ids = F.transform(chunks(F.col("folded")), lambda c: digest(c, bits))
        return stored(texts.select("row", "rest", sha, ids.alias("recipe")), "recipes")

    texts = stored(texts, "numbered-texts")  # row numbers must not change between the two reads below
    pieces = texts.select("row", F.posexplode(chunks(F.col("folded"))).alias("at", "chunk"))
    pieces = pieces.withColumn("digest", digest(F.col("chunk"), bits))
    # a chunk is its own number among the few that share its digest
    variants = pieces.join(shared, "digest", "left_semi").select("digest", "chunk").distinct()
    variants = variants.groupBy("digest").agg(F.sort_array(F.collect_list("chunk")).alias("texts"))
    variants = variants.select("digest", F.posexplode("texts").alias("variant", "chunk"))
    named = pieces.join(variants, ["digest", "chunk"], "left").select(
        "row", F.struct("at", F.struct("digest", F.coalesce("variant", F.lit(0)).alias("variant")).alias("id")).alias("step")
    )
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list("step"))["id"].alias("recipe"))
    none = F.array().cast(lists.schema["recipe"].dataType)
    whole = texts.select("row", "rest", sha).join(lists, "row", "left")
    return stored(whole.withColumn("recipe", F.coalesce("recipe", none)), "recipes")


def find_copies(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """All rows without their text, with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z. Every text is cut into chunks by its content. A chunk is known by a digest
    of `bits` bits, verified once: the different chunks meet by (digest, chunk), copies are merged before
    that shuffle, and digests that stand for two texts get numbered. From then on a document is the ordered list
    of its chunks' identifiers, about 8 bytes for a thousand characters; equal lists are equal texts. Long
    texts themselves don't move again. Lists are counted by partial aggregation and joined back, so a group that holds a third
    of all rows is counted where it lies and its rows may be split over tasks.

    Of a group one row stays: that with the largest `key`, among rows that repeat it the last read; null keys are
    smaller than any. Null and empty texts are one group. An empty table gives no rows. Input columns with the names of
    the output are replaced, all other columns but the text stay.
    """
    carried = keep_others(df, [text, *OUTPUT])
    texts = df.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*carried).alias("rest"), folded(F.col(text)).alias("folded")
    )
    rows = recipes(texts, bits)
    best = F.max(F.struct(F.col("rest")[key].alias("id"), "row")).alias("best")
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best)
    return rows.join(groups, "recipe").select(
        "rest.*",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, whole: one of each group of equal texts."""
    kept = find_copies(df.select(key, text), key, text).where("kept")
    kept = kept.select(F.struct(key, "text_sha256").alias("_kept"))
    marked = df.withColumn("_kept", F.struct(key, F.sha2(folded(F.col(text)), 256).alias("text_sha256")))
    return marked.join(kept, marked["_kept"].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(["_kept"]).drop("_kept")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its copies."""
    return find_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = {
    "op11_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
}
