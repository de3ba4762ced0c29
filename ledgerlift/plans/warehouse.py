"""Customer, policy and claims workloads built from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.joins import hash_lookup, lookup_join, merge_by
from ledgerlift.operators.ordering import nodupkey
from ledgerlift.operators.procs import univariate


def dim_customer(customers_raw: DataFrame, addresses: DataFrame) -> DataFrame:
    """The customer row that was loaded first, with its address."""
    customers = nodupkey(customers_raw, ["customer_id"], ["load_seq"])
    return lookup_join(customers, addresses, ["customer_id"])


def fact_policies(policies: DataFrame, dim: DataFrame, products: DataFrame) -> DataFrame:
    """Policies of known customers with product attributes; the source language's BY merge."""
    known = lookup_join(policies, dim, ["customer_id"], ["customer_name", "segment"], how="inner")
    merged = merge_by(known, products, ["product_code"], keep="a")
    return merged.withColumn("total_premium", F.col("premium_amount"))


def fact_claims(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """Claims whose policy is known, with the claim to premium ratio."""
    found = hash_lookup(claims, policies, ["policy_id"], ["customer_id", "product_code", "premium_amount"])
    return found.withColumn("ratio", F.try_divide(F.col("claim_amount"), F.col("premium_amount")))


def per_segment(df: DataFrame, segment: str, aggs: dict[str, Column], segments: list[str] | None = None) -> DataFrame:
    """A macro called once per segment value: one job with the segment as group key."""
    rows = df.where(F.col(segment).isin(segments)) if segments else df
    return rows.groupBy(segment).agg(*[c.alias(n) for n, c in aggs.items()])


def segment_profile(dim: DataFrame, segment: str, variables: list[str]) -> DataFrame:
    """Univariate tables of every segment, concatenated."""
    return univariate(dim, variables, [segment])
