"""A training corpus from `documents`: language, near copies, repeated passages, mixture, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each one's rows as Parquet in
the shared folder and gives them to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlift.llm import langid, minhash, mixing, packing, substring
from ledgerlift.session import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a margin; the others go."""
    dictionaries = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs, dictionaries).where(~F.col("rejected")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows that repeat a doc_id are one document.

    Rows without a doc_id are in no group and stay.
    """
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    first = Window.partitionBy("doc_id").orderBy(*rest)
    one = docs.join(kept, "doc_id", "left_semi").withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 35 words that occur twice; n_chars follows the text."""
    out = substring.remove_repeats(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_rows(mixing.mixture(docs)).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed documents."""
    return packing.pieces(packing.pack_documents(docs))


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: Compression, min-hashing and tokenising have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
