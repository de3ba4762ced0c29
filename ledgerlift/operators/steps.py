"""Row steps: projection, filters, derived columns, decision tables, buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.semantics import eq, le


def data_step(
    df: DataFrame,
    assigns: dict[str, Column] | list[dict[str, Column]] | None = None,
    keep: list[str] | None = None,
    drop: list[str] | None = None,
    rename: dict[str, str] | None = None,
    where: Column | None = None,
    delete: Column | None = None,
) -> DataFrame:
    """SET one source: filter, assign, delete, select.

    A list of assignments is applied in order, each dict seeing the columns of the ones
    before it; within one dict the right sides see the row as it was.
    """
    out = df if where is None else df.where(where)
    for group in assigns if isinstance(assigns, list) else [assigns or {}]:
        out = out.withColumns(group) if group else out
    if delete is not None:
        out = out.where(~F.coalesce(delete, F.lit(False)))
    if drop:
        out = out.drop(*drop)
    if keep:
        out = out.select(*keep)
    return out.withColumnsRenamed(rename) if rename else out


def add_constants(df: DataFrame, values: dict) -> DataFrame:
    """Columns of one value each; None makes an empty text column."""
    return df.withColumns(
        {n: F.lit(v) if v is not None else F.lit(None).cast("string") for n, v in values.items()}
    )


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conds])


def inconsistency_flag(
    zero: list[str] = (), missing_or_zero: list[str] = (), dates: list[str] = (),
    ordered: tuple[str, str] | None = None, oldest: str = "1900-12-30",
) -> Column:
    """'S' when any field is unusable, else 'N'."""
    tests = [F.col(c) == 0 for c in zero]
    tests += [F.col(c).isNull() | (F.col(c) == 0) for c in missing_or_zero]
    tests += [le(F.col(c), F.lit(oldest).cast("date")) for c in dates]
    if ordered:
        start, end = ordered
        tests.append(le(F.col(end), F.col(start)))
    return F.when(any_of(*tests), F.lit("S")).otherwise(F.lit("N"))


# Upper bounds in days and the labels of the aging list.
AGING_BOUNDS = [30, 60, 120, 180, 365]
AGING_AHEAD = [
    "AV.000 a 030 dias", "av.031 a 060 dias", "av.061 a 120 dias",
    "av.121 a 180 dias", "av.181 a 365 dias", "av.acima de 365 dias",
]
AGING_OVERDUE = [
    "vc.001 a 030 dias venc", "vc.031 a 060 dias venc", "vc.061 a 120 dias venc",
    "vc.121 a 180 dias venc", "vc.181 a 365 dias venc", "vc.acima de 365 dias venc",
]
AGING_NONE = "Nenhuma das anteriores"


def aging_bucket(days: Column, invalid: Column) -> Column:
    """Label of signed days to the due date; invalid or missing days fall outside the list."""
    size = F.abs(days)
    step = F.when(size <= AGING_BOUNDS[0], 0)
    for i, bound in enumerate(AGING_BOUNDS[1:], start=1):
        step = step.when(size <= bound, i)
    place = step.otherwise(len(AGING_BOUNDS)) + F.when(days < 0, len(AGING_AHEAD)).otherwise(0)
    labels = F.array(*[F.lit(x) for x in AGING_AHEAD + AGING_OVERDUE])
    return F.when(invalid | days.isNull(), F.lit(AGING_NONE)).otherwise(F.get(labels, place))


def decision_table(rules: list[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for cond, label in rules[1:]:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def same_text(c: Column, value: str) -> Column:
    return eq(c, value)
