"""Data sets in transport files (version 5 of the published format): inventory, columns, rows; and rows as such files.

A file is a chain of 80-byte records: a library header, then for each data set a member header, one
140-byte description per variable, and the observations back to back. Numbers are base-16 floats,
cut to the variable's length. A file is decoded by the task that holds it, observations in batches as arrays.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.operators.schema import DAY_ZERO, DATETIME_FORMATS, DATE_FORMATS

BATCH_ROWS = 20_000
META = (
    "path string, dataset_name string, label string, row_count bigint, column_count int, "
    "columns array<struct<position:int,name:string,type:string,length:int,format:string,label:string>>"
)
ROWS = "path string, dataset_name string, row_no bigint, numbers array<double>, texts array<string>"

# Headers of the format, filled to 80 bytes, and the layout of a variable's description.
_HEADER = "HEADER RECORD*******{:<8}HEADER RECORD!!!!!!!"
_LIBRARY, _MEMBER, _DESCRIPTOR, _NAMES, _ROWS = (_HEADER.format(k).encode() for k in ("LIBRARY", "MEMBER", "DSCRPTR", "NAMESTR", "OBS"))
_VARIABLE = struct.Struct(">hhhh8s40s8shhh2s8shhl52s")
_FORMAT = re.compile(r"(\$?(?:[A-Za-z0-9]*[A-Za-z])?)(\d*)\.?(\d*)")
_MISSING = np.frombuffer(b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)


@dataclass
class Variable:
    name: str
    number: bool
    length: int
    place: int
    format: str
    label: str


@dataclass
class Member:
    name: str
    label: str
    variables: list[Variable]
    first: int
    width: int
    rows: int


def _text(raw: bytes) -> str:
    return raw.decode("cp1252", "replace").rstrip(" \x00")


def _format(name: str, width: int, places: int) -> str:
    if not name:
        return ""
    return f"{name}{width or ''}.{places or ''}"


def members(content: bytes) -> Iterator[Member]:
    """The data sets of a file, one after the other; trailing rows that are all blank are padding."""
    if not content.startswith(_LIBRARY):
        raise ValueError("not a transport file of version 5")
    at = 240
    while at < len(content):
        if content[at : at + 48] != _MEMBER:
            raise ValueError(f"no member header at byte {at}")
        size = int(content[at + 74 : at + 78])
        name, label = _text(content[at + 168 : at + 176]), _text(content[at + 240 + 32 : at + 240 + 72])
        at += 320
        if content[at : at + 48] != _NAMES:
            raise ValueError(f"no variable header at byte {at}")
        count = int(content[at + 54 : at + 58])
        at += 80
        variables = []
        for i in range(count):
            kind, _, length, _, v, lab, form, fl, fd, _, _, _, _, _, place, _ = _VARIABLE.unpack(content[at + i * size : at + i * size + 140])
            variables.append(Variable(_text(v), kind == 1, length, place, _format(_text(form), fl, fd), _text(lab)))
        at += -(-count * size // 80) * 80
        if content[at : at + 48] != _ROWS:
            raise ValueError(f"no observation header at byte {at}")
        at += 80
        end = content.find(_MEMBER, at)
        while end >= 0 and (end - at) % 80:
            end = content.find(_MEMBER, end + 1)
        end = len(content) if end < 0 else end
        width = sum(v.length for v in variables)
        rows = (end - at) // width if width else 0
        while rows and end - at - (rows - 1) * width < 80 and not content[at + (rows - 1) * width : end].strip(b" "):
            rows -= 1
        yield Member(name, label, variables, at, width, rows)
        at = end


def to_numbers(raw: np.ndarray) -> np.ndarray:
    """Base-16 floats of (rows, length) bytes as doubles; special and ordinary missing values are NaN."""
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    missing = np.isin(wide[:, 0], _MISSING) & ~wide[:, 1:].any(axis=1)
    bits = wide.reshape(-1).view(">u8").astype(np.uint64)
    fraction = (bits & np.uint64(2**56 - 1)).astype(np.float64)
    exponent = ((bits >> np.uint64(56)) & np.uint64(127)).astype(np.int64)
    value = np.ldexp(fraction, (4 * (exponent - 64) - 56).astype(np.int32))
    value = np.where((bits >> np.uint64(63)) != 0, -value, value)
    return np.where(missing, np.nan, value)


def from_numbers(values: np.ndarray) -> np.ndarray:
    """Doubles as (rows, 8) bytes of base-16 floats; NaN is the ordinary missing value, what is too large or small is an error."""
    mantissa, exponent = np.frexp(np.abs(np.nan_to_num(values)))
    digits = -(-exponent // 4)
    if np.isinf(values).any() or (digits[mantissa > 0] > 63).any() or (digits[mantissa > 0] < -64).any():
        raise ValueError("a number has no place in a transport file")
    fraction = np.ldexp(mantissa, 56 + exponent - 4 * digits).astype(np.uint64)
    bits = fraction | ((digits + 64).astype(np.uint64) << np.uint64(56)) | (np.signbit(values).astype(np.uint64) << np.uint64(63))
    out = np.where(fraction == 0, np.uint64(0), bits).astype(">u8").view(np.uint8).reshape(-1, 8).copy()
    out[np.isnan(values)] = [0x2E, 0, 0, 0, 0, 0, 0, 0]
    return out


def member_meta(files: DataFrame) -> DataFrame:
    """Metadata of every data set in transport files given as rows (path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [(
                    path, m.name, m.label, m.rows, len(m.variables),
                    [{"position": i, "name": v.name, "type": "num" if v.number else "char", "length": v.length, "format": v.format, "label": v.label}
                     for i, v in enumerate(m.variables)],
                ) for m in members(content)]
                yield pd.DataFrame(rows, columns=["path", "dataset_name", "label", "row_count", "column_count", "columns"])

    return files.select("path", "content").mapInPandas(read, META)


def member_rows(files: DataFrame, dataset: str = r".*") -> DataFrame:
    """(path, dataset_name, row_no, numbers, texts): observations of matching data sets, numeric and character values in the variables' order.

    Missing numbers are null. Texts lose their trailing blanks.
    """
    pattern = re.compile(dataset)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for m in members(content):
                    if not pattern.fullmatch(m.name):
                        continue
                    for start in range(0, m.rows, BATCH_ROWS):
                        n = min(BATCH_ROWS, m.rows - start)
                        raw = np.frombuffer(content, np.uint8, n * m.width, m.first + start * m.width).reshape(n, m.width)
                        field = lambda v: raw[:, v.place : v.place + v.length]  # noqa: E731, B023
                        numbers = [to_numbers(field(v)) for v in m.variables if v.number]
                        texts = [[_text(x.tobytes()) for x in field(v)] for v in m.variables if not v.number]
                        rows = np.column_stack(numbers) if numbers else np.zeros((n, 0))
                        yield pd.DataFrame({
                            "path": path, "dataset_name": m.name, "row_no": np.arange(start + 1, start + n + 1),
                            "numbers": [[None if x != x else x for x in r] for r in rows.tolist()],
                            "texts": [list(t) for t in zip(*texts)] if texts else [[]] * n,
                        })

    return files.select("path", "content").mapInPandas(read, ROWS)


def _typed(value: Column, fmt: str) -> Column:
    """A number by its display format: days or seconds since 1960, else as it is."""
    form = _FORMAT.fullmatch(fmt.strip())
    kind = form[1].lower() if form else ""

    def plain(names: list[str]) -> set[str]:
        return {n.rstrip("0123456789") for n in names}

    if kind in plain(DATETIME_FORMATS):
        return F.lit(f"{DAY_ZERO} 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=value.cast("decimal(18,6)"))
    if kind in plain(DATE_FORMATS):
        return F.date_add(F.lit(DAY_ZERO).cast("date"), F.floor(value).cast("int"))
    return value


def member_table(rows: DataFrame, columns: list[dict]) -> DataFrame:
    """Named, typed columns of observations by the metadata of their data set (name, type and format, in order)."""
    out, place = [], {"num": 0, "char": 0}
    for col in columns:
        value = F.get("numbers" if col["type"] == "num" else "texts", F.lit(place[col["type"]]))
        place[col["type"]] += 1
        out.append((_typed(value, col.get("format") or "") if col["type"] == "num" else value).alias(col["name"].lower()))
    return rows.select(*out)


def transport_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][pP][tT]")
    return files.load(path).select("path", "content")


def read_transport(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """One data set of all transport files of a folder, its parts appended; parts must have the same columns."""
    files = transport_files(spark, path)
    layouts = member_meta(files).where(F.col("dataset_name") == dataset).select(
        F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["format"].alias("format"))).alias("columns")
    ).distinct().limit(2).collect()
    if len(layouts) != 1:
        raise ValueError(f"{dataset}: " + ("no such data set" if not layouts else "its parts have different columns"))
    return member_table(member_rows(files, re.escape(dataset)), [c.asDict() for c in layouts[0]["columns"]])


def _padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % 80)


def _file(name: str, variables: list[Variable], data: bytes) -> bytes:
    stamp = b"01JAN60:00:00:00"
    head = lambda h, tail="0" * 30: _padded(h + tail.encode())
    word = lambda s, n: s.encode("cp1252", "replace")[:n].ljust(n)
    names = b""
    for i, v in enumerate(variables, start=1):
        form = _FORMAT.fullmatch(v.format)
        names += _VARIABLE.pack(1 if v.number else 2, 0, v.length, i, word(v.name, 8), word(v.label, 40), word(form[1], 8), int(form[2] or 0),
                                int(form[3] or 0), 0, b"  ", b" " * 8, 0, 0, v.place, b"\x00" * 52)
    return b"".join([
        head(_LIBRARY), _padded(b"SAS     SAS     SASLIB  9.4     " + b" " * 32 + stamp), _padded(stamp),
        head(_MEMBER, "000000000000000001600000000140"), head(_DESCRIPTOR),
        _padded(b"SAS     " + word(name, 8) + b"SASDATA 9.4     " + b" " * 32 + stamp), _padded(stamp),
        head(_NAMES, f"000000{len(variables):04d}" + "0" * 20), _padded(names), head(_ROWS), _padded(data),
    ])


def transport_of(df: DataFrame, dataset: str, formats: dict[str, str] | None = None, widths: dict[str, int] | None = None) -> DataFrame:
    """(path, content): the rows of `df` as transport files of one data set, one per batch of a task.

    Numbers become numbers, dates days and timestamps seconds since 1960 (with a format that says so), other kinds text of
    the width given (8 without). Names are cut to 8 letters by the format; longer ones must be renamed before.
    """
    formats, widths = formats or {}, widths or {}
    variables, cols, place = [], [], 0
    for name, kind in df.dtypes:
        if len(name) > 8:
            raise ValueError(f"{name} is longer than 8 letters")
        number = kind in ("double", "float", "bigint", "int", "smallint", "tinyint", "date", "timestamp_ntz") or kind.startswith("decimal")
        value, fmt = F.col(name).cast("string"), formats.get(name, "")
        if number and kind not in ("date", "timestamp_ntz"):
            value = F.col(name).cast("double")
        elif kind == "date":
            value, fmt = F.date_diff(F.col(name), F.lit(DAY_ZERO).cast("date")).cast("double"), fmt or "DATE9."
        elif kind == "timestamp_ntz":
            days = F.date_diff(F.col(name).cast("date"), F.lit(DAY_ZERO).cast("date"))
            clock = F.hour(name) * 3600 + F.minute(name) * 60 + F.extract(F.lit("SECOND"), F.col(name)).cast("double")
            value, fmt = days * 86400.0 + clock, fmt or "DATETIME20."
        length = 8 if number else widths.get(name, 8)
        variables.append(Variable(name.upper(), number, length, place, fmt, ""))
        cols.append(value.alias(name))
        place += length

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            fields = []
            for v, name in zip(variables, batch.columns):
                if v.number:
                    fields.append(from_numbers(batch[name].to_numpy(np.float64)))
                else:
                    raw = b"".join((x or "").encode("cp1252", "replace")[: v.length].ljust(v.length) for x in batch[name])
                    fields.append(np.frombuffer(raw, np.uint8).reshape(len(batch), v.length))
            data = np.ascontiguousarray(np.hstack(fields)).tobytes()
            yield pd.DataFrame({"path": [f"{dataset}-{hashlib.sha1(data).hexdigest()[:16]}.xpt"], "content": [_file(dataset, variables, data)]})

    return df.select(*cols).mapInPandas(pack, "path string, content binary")
