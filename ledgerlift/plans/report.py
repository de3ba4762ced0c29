"""Key figures of a whole estate as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators import corpus as C
from ledgerlift.operators import lineage as L
from ledgerlift.operators import rules as R
from ledgerlift.operators import scoring as S
from ledgerlift.session import stored


def environment_report(programs: DataFrame, datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows (measure, value): programs, lines, procedures, complexity, strategy, datasets, rows, lineage, findings.

    One table of parsed facts and rule facts is written in a single reading of the text and
    feeds every figure.
    """
    parsed = stored(R.facts(C.extract(programs), keep=list(C.FIELDS)), "facts")
    scored = S.complexity(parsed)
    heavy = F.col("complexity_level").isin("HIGH", "VERY_HIGH")

    def one(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("string").alias("value")).select(F.lit(name).alias("measure"), "value")

    def per(df: DataFrame, prefix: str, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).cast("string").alias("value")).select(
            F.concat(F.lit(prefix), F.col(key)).alias("measure"), "value")

    rows = F.count(F.lit(1))
    strategy = F.when(F.max(heavy), "Phased migration recommended").otherwise("Straightforward migration feasible")
    parts = [
        one(parsed, "programs", rows),
        one(parsed, "lines", F.sum("line_count")),
        one(scored, "strategy", strategy),
        per(scored, "complexity:", "complexity_level"),
        one(parsed.select(F.explode("procs_used").alias("p")), "procs", F.count_distinct("p")),
        one(datasets, "datasets", rows),
        one(datasets, "data_rows", F.sum(F.when(F.col("row_count") > 0, F.col("row_count")))),
        one(L.lineage_edges(parsed), "lineage_edges", rows),
        one(L.lineage_nodes(parsed), "lineage_nodes", rows),
        per(R.find_in(parsed), "findings:", "severity"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
