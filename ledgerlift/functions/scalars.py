"""Scalar functions of the source language as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlift.functions.semantics import lt


def ifn(cond: Column, a, b) -> Column:
    """`a` where cond holds, else `b`; an undecided condition takes `b`."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(cond, a).otherwise(b)


ifc = ifn


def mdy(month: Column, day: Column, year: Column) -> Column:
    """Date from its parts, missing when the parts name no day."""
    zero = F.lit(0)
    return F.try_make_timestamp(year, month, day, zero, zero, F.lit(0.0)).cast("date")


def period(d: Column) -> Column:
    """yyyymm as a number."""
    return F.year(d) * 100 + F.month(d)


def next_period(d: Column) -> Column:
    """First day of the month after `d`."""
    return F.add_months(F.trunc(d, "MM"), 1)


def day_number(d: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(d)


def days_between(end: Column, start: Column, inclusive: bool = False) -> Column:
    days = F.date_diff(end, start)
    return days + 1 if inclusive else days


def months_late(due: Column, ref: Column) -> Column:
    """Whole months from `due` to `ref`; -2 when due after the month that follows `ref`."""
    late = F.year(ref) * 12 + F.month(ref) - F.year(due) * 12 - F.month(due)
    return F.when(period(due) > period(next_period(ref)), F.lit(-2)).otherwise(late)


def prorata_days(remaining: Column, term: Column, invalid: Column) -> Column:
    """Unearned share of a term: 0 when invalid, over or missing, 1 when longer than the term."""
    share = F.when(remaining > term, F.lit(1.0)).otherwise(F.try_divide(remaining.cast("double"), term.cast("double")))
    return F.when((remaining > 0) & (term > 0) & ~invalid, share).otherwise(F.lit(0.0))


def prorata_window(lo: Column, hi: Column, ref: Column) -> Column:
    """Share of the window [lo, hi] (day numbers) that lies after `ref`; 0 when an end is missing."""
    share = F.when(lo >= ref, F.lit(1.0)).otherwise((hi - ref) / (hi - lo))
    return F.when((hi > lo) & (hi > ref), share).otherwise(F.lit(0.0))


def installment_window(start: Column, end: Column, count: Column, number: Column, whole: Column):
    """Day numbers (fractions kept) at which one of `count` equal installments begins and ends."""
    first, last = day_number(start).cast("double"), day_number(end).cast("double")
    undivided = F.coalesce(count == 0, F.lit(False)) | lt(last - first, 31.0) | whole
    step = F.try_divide(last - first, count.cast("double"))
    lo = F.when(undivided, first).otherwise(first + step * (number - 1))
    hi = F.when(undivided, last).otherwise(first + step * number)
    return lo, hi


def put_z(n: Column, width: int) -> Column:
    """Zero-padded digits; numbers wider than the field keep all their digits."""
    digits = F.abs(n.cast("bigint")).cast("string")
    sign = F.when(n < 0, "-").otherwise("")
    room = F.greatest(F.length(digits), F.lit(width) - F.length(sign))
    return F.coalesce(F.concat(sign, F.lpad(digits, room, F.lit("0"))), F.lit("."))


def cats(*cols: Column) -> Column:
    """Concatenate with leading and trailing blanks of each part removed."""
    return F.concat(*[F.coalesce(F.trim(c.cast("string")), F.lit("")) for c in cols])


def substr(c: Column, pos: int, length: int) -> Column:
    return F.substring(c, pos, length)


def entry_side(amount: Column, receivable: Column) -> Column:
    """D or C. Receivables below zero are debits; all other accounts below zero are credits."""
    below = lt(amount, 0)
    return F.when(receivable, F.when(below | (amount == 0), F.lit("D")).otherwise(F.lit("C"))).otherwise(
        F.when(below, F.lit("C")).otherwise(F.lit("D"))
    )


def weighted_split(amount: Column, weights: dict[str, float]) -> dict[str, Column]:
    return {name: F.lit(w) * amount for name, w in weights.items()}


def scan_word(text: Column, index: int, sep: str = " ") -> Column:
    """The index-th word, runs of separators counting once; negative counts from the end."""
    words = F.filter(F.split(text, f"[{sep}]+"), lambda w: w != "")
    position = F.lit(index - 1) if index > 0 else F.size(words) + index
    return F.get(words, position)


# The clean-up steps that define a file stem, applied in this order.
STEM_STEPS = [
    (r"&\w+\.?", ""),
    (r"\\", "/"),
    (r"^.*/", ""),
    (r"^(.*[^.].*)\.[^.]*$", "$1"),
    (r"^\d+_", ""),
    (r"_\d+$", ""),
    (r"^_+", ""),
    (r"_+$", ""),
]


def path_stem(path: Column) -> Column:
    """Distinctive lower-case stem of a file path, without macro references or number affixes."""
    return F.lower(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), STEM_STEPS, path))


def format_bytes(n: Column) -> Column:
    """Size in units of 1024 with one decimal (none for bytes)."""
    units = ["KB", "MB", "GB", "TB"]

    def scaled(k: int, unit: str) -> Column:
        value = F.bround(n.cast("double") / F.lit(float(1024**k)), 1)
        return F.format_string(f"%.1f {unit}", value)

    out = F.when(F.abs(n) < 1024, F.format_string("%d B", n.cast("bigint")))
    for k, unit in enumerate(units, start=1):
        out = out.when(F.abs(n.cast("double")) < float(1024 ** (k + 1)), scaled(k, unit))
    return out.otherwise(scaled(5, "PB"))


def safe_filename(name: Column) -> Column:
    replaced = F.regexp_replace(name, r"[^\p{L}\p{N}_\-.]", "_")
    return F.regexp_replace(replaced, "^_+|_+$", "")


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def normalize_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def value_map(c: Column, mapping: dict, default=None) -> Column:
    """First matching value of an IF / ELSE IF chain, or `default`."""
    out = None
    for value, label in mapping.items():
        test = c == F.lit(value)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))
