"""Text to value (informats) and value to text (formats)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date informats and the day/month/year order they read.
DATE_ORDERS = {
    "DDMMYY": "dd/MM/yyyy",
    "MMDDYY": "MM/dd/yyyy",
    "YYMMDD": "yyyy/MM/dd",
    "DATE": "ddMMMyyyy",
    "DATETIME": "ddMMMyyyy:HH:mm:ss",
}


def split_spec(spec: str) -> tuple[str, int, int]:
    """'COMMAX13.2' -> ('COMMAX', 13, 2)."""
    name, width, places = re.fullmatch(r"\$?([A-Za-z]*)(\d*)\.?(\d*)", spec.strip()).groups()
    return name.upper(), int(width or 0), int(places or 0)


def informat_num(text: Column, spec: str = "BEST12.") -> Column:
    """Number from text; anything unreadable is missing."""
    name, _, places = split_spec(spec)
    plain = F.trim(text)
    if name in ("COMMA", "COMMAX", "DOLLAR", "PERCENT"):
        plain = F.regexp_replace(plain, r"[$%\s]", "")
        plain = F.regexp_replace(plain, r"^\((.*)\)$", "-$1")
        if name == "COMMAX":
            plain = F.translate(F.regexp_replace(plain, r"\.", ""), ",", ".")
        else:
            plain = F.regexp_replace(plain, ",", "")
    value = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    if places:
        value = F.when(plain.contains("."), value).otherwise(value / F.lit(float(10**places)))
    if name == "PERCENT":
        value = F.when(F.trim(text).endswith("%"), value / 100.0).otherwise(value)
    return value


def informat_date(text: Column, spec: str = "DDMMYY10.") -> Column:
    """Date (or timestamp for DATETIME) from text; an impossible day is missing."""
    name, _, _ = split_spec(spec)
    pattern = DATE_ORDERS[name]
    plain = F.trim(text)
    if name == "DATETIME":
        return F.try_to_timestamp(F.initcap(plain), F.lit(pattern))
    if name == "DATE":
        return F.try_to_timestamp(F.initcap(plain), F.lit(pattern)).cast("date")
    joined = F.regexp_replace(plain, r"[.\-]", "/")
    return F.coalesce(
        F.try_to_timestamp(joined, F.lit(pattern)),
        F.try_to_timestamp(plain, F.lit(pattern.replace("/", ""))),
    ).cast("date")


def informat_char(text: Column, spec: str) -> Column:
    """Text cut to the declared width; blank is missing."""
    _, width, _ = split_spec(spec)
    cut = F.substring(text, 1, width) if width else text
    return F.when(F.trim(cut) != "", F.rtrim(cut))


def informat(text: Column, spec: str) -> Column:
    name, _, _ = split_spec(spec)
    if spec.startswith("$") or name == "CHAR":
        return informat_char(text, spec)
    return informat_date(text, spec) if name in DATE_ORDERS else informat_num(text, spec)


def put_comma(n: Column, places: int = 2) -> Column:
    return F.format_number(n, places)


def put_commax(n: Column, places: int = 2) -> Column:
    """Digits grouped by dots with a decimal comma."""
    return F.translate(F.format_number(n, places), ",.", ".,")


def put_dollar(n: Column, places: int = 2) -> Column:
    body = F.concat(F.lit("$"), F.format_number(F.abs(n), places))
    return F.when(n < 0, F.concat(F.lit("-"), body)).otherwise(body)


def put_ddmmyy(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")
