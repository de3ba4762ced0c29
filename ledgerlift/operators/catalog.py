"""Data catalog: sensitive columns, business domain, sensitivity, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.operators.schema import source_type

# Words that mark personal data, domains in the order they are tested, and
# words that mark reference tables.
PII_KEYWORDS = [
    "cpf", "email", "phone", "telefone", "salary", "salario", "ssn", "rg", "nome", "name", "address", "endereco",
]
DOMAIN_KEYWORDS = {
    "Customer": ["customer", "client", "pessoa", "cadastro"],
    "Financial": ["payment", "transaction", "premium", "amount", "financial", "revenue"],
    "Risk": ["risk", "score", "model", "scoring"],
    "Product": ["product", "produto", "item"],
    "Claims": ["claim", "sinistro"],
    "Policy": ["policy", "apolice", "contract"],
}
REFERENCE_WORDS = ["lookup", "ref", "product", "code", "type"]
DOMAINS = [*DOMAIN_KEYWORDS, "General"]


def pii_columns(columns: DataFrame) -> DataFrame:
    """Columns whose name contains a personal-data word."""
    return columns.where(F.lower("name").rlike("|".join(PII_KEYWORDS)))


def pii_exact_flag(columns: DataFrame) -> DataFrame:
    """Flag of columns whose whole name is a personal-data word."""
    return columns.withColumn("is_pii", F.lower("name").isin(PII_KEYWORDS))


def domain_rank(text: Column) -> Column:
    """Place of the first domain one of whose words the text contains."""
    lowered, out = F.lower(text), None
    for i, words in enumerate(DOMAIN_KEYWORDS.values()):
        test = lowered.rlike("|".join(words))
        out = F.when(test, i) if out is None else out.when(test, i)
    return out.otherwise(len(DOMAIN_KEYWORDS))


def _domain(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in DOMAINS]), rank)


def _reference(row_count: Column, name: Column) -> Column:
    return ((row_count > 0) & (row_count <= 100)) | F.lower(name).rlike("|".join(REFERENCE_WORDS))


def reference_table_flag(datasets: DataFrame) -> DataFrame:
    return datasets.withColumn("is_reference", _reference(F.col("row_count"), F.col("dataset_name")))


def catalog_datasets(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Domain, sensitivity and personal-data columns of every dataset.

    No keyword holds a blank, so the first domain of the joined names is the smallest rank
    over the single names: an aggregate, with no text put together.
    """
    pii = F.lower("name").rlike("|".join(PII_KEYWORDS))
    per = columns.groupBy("dataset_name").agg(
        F.min(domain_rank(F.col("name"))).alias("_rank"),
        F.array_sort(F.collect_list(F.when(pii, F.struct("position", "name")))).alias("_pii"),
    )
    joined = datasets.join(per, "dataset_name", "left")
    rank = F.least(F.coalesce("_rank", F.lit(len(DOMAIN_KEYWORDS))), domain_rank(F.col("dataset_name")))
    names = F.coalesce(F.col("_pii")["name"], F.array().cast("array<string>"))
    sensitivity = (
        F.when(F.size(names) > 0, "Restricted")
        .when(_reference(F.col("row_count"), F.col("dataset_name")), "Public")
        .otherwise("Internal")
    )
    return joined.select(
        "dataset_name", "row_count", "column_count", _domain(rank).alias("domain"),
        sensitivity.alias("sensitivity"), F.array_join(names, ", ").alias("pii_columns"),
        F.size(names).alias("n_pii"),
    )


def infer_domain(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    return catalog_datasets(datasets, columns).select("dataset_name", "domain")


def sensitivity(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    return catalog_datasets(datasets, columns).select("dataset_name", "sensitivity")


def pii_alerts(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per dataset with personal data and what to do about it."""
    return catalog_datasets(datasets, columns).where("n_pii > 0").select(
        "dataset_name", "pii_columns", "sensitivity", "domain",
        F.lit("mask before migration; review privacy compliance").alias("advice"),
    )


def catalog_summary(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows (measure, value): totals, datasets per domain and per sensitivity, datasets with personal data."""
    entries = catalog_datasets(datasets, columns)
    totals = entries.agg(
        F.count(F.lit(1)).alias("total_datasets"), F.sum("column_count").alias("total_columns"),
        F.count(F.when(F.col("n_pii") > 0, 1)).alias("datasets_with_pii"),
    )
    long = totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in totals.columns
    ])))
    counted = [
        entries.groupBy(c).agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit(f"{c}:"), c).alias("measure"), "value")
        for c in ("domain", "sensitivity")
    ]
    return reduce(lambda a, b: a.unionByName(b), [long, *counted])


def build_catalog(datasets: DataFrame, columns: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": catalog_summary(datasets, columns),
        "datasets": catalog_datasets(datasets, columns),
        "columns": pii_exact_flag(columns),
        "alerts": pii_alerts(datasets, columns),
    }


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Name and row count of every table, one distributed count each."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("dataset_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def profile_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Dataset and column tables of live DataFrames: schemas from the plans, counts from the data."""
    fields = [
        (name, i, f.name, *source_type(f.dataType.simpleString()))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    columns = spark.createDataFrame(
        fields, "dataset_name string, position int, name string, type string, format string"
    ).withColumns({"length": F.lit(0), "label": F.lit("")})
    widths = columns.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("column_count"))
    return row_counts(tables).join(widths, "dataset_name"), columns
