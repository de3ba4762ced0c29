"""Summary procedures: frequency, means, univariate, tabulate, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.keys import attach
from ledgerlift.operators.ordering import percentiles, row_numbers, running_total


def freq(df: DataFrame, cols: list[str], missing: bool = True, percents: bool = True,
         cumulative: bool = False) -> DataFrame:
    """Frequency of the value combinations of `cols`, with shares of the total.

    Two columns add row and column percents; `cumulative` adds running count and percent
    in value order. Totals are aggregates of the cells, never a window over all of them.
    """
    rows = df.select(*cols)
    if not missing:
        rows = rows.dropna()
    cells = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("frequency"))
    if not percents:
        return cells
    total = cells.agg(F.sum("frequency")).scalar()
    out = cells.withColumn("percent", F.col("frequency") * 100 / total)
    if len(cols) == 2:
        for side, name in ((cols[0], "row_percent"), (cols[1], "col_percent")):
            sums = cells.groupBy(side).agg(F.sum("frequency").alias("_sum"))
            out = attach(out, sums, [side], how="inner")
            out = out.withColumn(name, F.col("frequency") * 100 / F.col("_sum")).drop("_sum")
    if cumulative:
        out = running_total(out, [], cols, "frequency", "cum_frequency")
        out = out.withColumn("cum_percent", F.col("cum_frequency") * 100 / total)
    return out


# Statistics of the means table and the aggregate each one is.
MEANS_STATS = {
    "n": lambda c: F.count(c).cast("double"),
    "n_rows": lambda c: F.count(F.lit(1)).cast("double"),
    "nmiss": lambda c: (F.count(F.lit(1)) - F.count(c)).cast("double"),
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
    "sum": lambda c: F.sum(c).cast("double"),
}


def _long(df: DataFrame, ids: list[str], variables: list[str], stats: list[str]) -> DataFrame:
    """One row per variable from columns named <variable>__<stat>."""
    rows = F.array(*[
        F.struct(F.lit(v).alias("variable"), *[F.col(f"{v}__{s}").alias(s) for s in stats])
        for v in variables
    ])
    return df.select(*ids, F.inline(rows))


def means(df: DataFrame, variables: list[str], stats: list[str] = ("n", "mean", "std", "min", "max"),
          class_cols: list[str] = (), all_ways: bool = False) -> DataFrame:
    """Statistics per variable, per class group; `all_ways` adds every coarser grouping.

    `type` numbers the grouping: one bit per class column, set when the column takes part.
    """
    class_cols, stats = list(class_cols), list(stats)
    aggs = [MEANS_STATS[s](F.col(v)).alias(f"{v}__{s}") for v in variables for s in stats]
    if not class_cols:
        return _long(df.agg(*aggs), [], variables, stats)
    if not all_ways:
        return _long(df.groupBy(*class_cols).agg(*aggs), class_cols, variables, stats)
    full = 2 ** len(class_cols) - 1
    cubed = df.cube(*class_cols).agg((F.lit(full) - F.grouping_id()).cast("bigint").alias("type"), *aggs)
    return _long(cubed, ["type", *class_cols], variables, stats)


# Quantiles of the univariate table.
UNIVARIATE_QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def univariate(df: DataFrame, variables: list[str], by: list[str] = (), method: str = "cont") -> DataFrame:
    """n, mean, std, min, max and exact quartiles per variable (and group)."""
    by = list(by)
    stats = ["n", "mean", "std", "min", "max"]
    basic = means(df, variables, stats, by)
    values = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    long = df.select(*by, F.inline(values))
    on = [*by, "variable"]
    quantiles = percentiles(long, on, "value", UNIVARIATE_QUANTILES, method)
    return attach(basic, quantiles, on, list(UNIVARIATE_QUANTILES))


def approx_quantiles(df: DataFrame, variables: list[str], probs: list[float] = (0.25, 0.5, 0.75),
                     err: float = 0.01) -> DataFrame:
    """Sketch-based quantiles with relative rank error `err`."""
    accuracy = int(round(1 / err))
    packed = df.agg(*[F.percentile_approx(v, list(probs), accuracy).alias(v) for v in variables])
    rows = F.array(*[
        F.struct(F.lit(v).alias("variable"), *[F.col(v)[i].cast("double").alias(f"q{int(p * 100)}") for i, p in enumerate(probs)])
        for v in variables
    ])
    return packed.select(F.inline(rows))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).describe()


def group_sums(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Grouped totals; `measures` maps output name -> aggregate."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def group_having(df: DataFrame, keys: list[str], measures: dict[str, Column], having: Column) -> DataFrame:
    """Grouped totals filtered on the computed totals."""
    return group_sums(df, keys, measures).where(having)


def nested_agg(df: DataFrame, inner: list[str], inner_aggs: dict[str, Column], outer: list[str],
               outer_aggs: dict[str, Column]) -> DataFrame:
    return group_sums(group_sums(df, inner, inner_aggs), outer, outer_aggs)


def monthly_kpi(df: DataFrame, date: str, entity: str, amount: str) -> DataFrame:
    """Per year and month: distinct entities, rows, total and average amount."""
    return df.groupBy(F.year(date).alias("yr"), F.month(date).alias("mo")).agg(
        F.count_distinct(entity).alias("unique_customers"),
        F.count(F.lit(1)).alias("total_policies"),
        F.sum(F.col(amount).cast("decimal(18,6)")).cast("double").alias("total_premium"),
        F.avg(amount).alias("avg_premium"),
    )


def tabulate(df: DataFrame, rows: list[str], cells: dict[str, Column], across: str | None = None,
             values: list | None = None) -> DataFrame:
    """Class rows by measure x statistic columns; `across` spreads the given values of a class over columns."""
    grouped = df.groupBy(*rows)
    if across:
        if not values:
            raise ValueError("name the values that become columns")
        grouped = grouped.pivot(across, values)
    return grouped.agg(*[c.alias(n) for n, c in cells.items()])


def report(df: DataFrame, group: list[str], sums: list[str] = (), averages: list[str] = (),
           display: dict | None = None) -> DataFrame:
    """Group and analysis columns; `display` maps a column to its display format."""
    out = df.groupBy(*group).agg(
        *[F.sum(F.col(c).cast("decimal(28,6)")).cast("double").alias(c) for c in sums],
        *[F.avg(c).alias(c) for c in averages],
    )
    return out.withColumns({c: f(F.col(c)) for c, f in (display or {}).items()})


def value_list(df: DataFrame, col: str) -> DataFrame:
    """Distinct values in order as rows (place, value): a list of any length."""
    values = df.select(F.col(col).cast("string").alias("value")).distinct().where("value is not null")
    return row_numbers(values, [], ["value"], "place").select("place", "value")


def distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
