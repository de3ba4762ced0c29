"""Spreadsheet workbooks (Office Open XML) as rows, and rows as workbooks.

A workbook is unpacked by the task that holds it: sheets are parsed as a stream and rows leave in batches, so
only the shared texts of one workbook are held. Many workbooks spread over many tasks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.functions.informats import DATE_ORDERS, informat, split_spec

#: Rows that leave a task at a time, and the most rows of a sheet by the format's own limit.
BATCH_ROWS, SHEET_ROWS = 5000, 1_048_576
ROWS = "path string, sheet string, row_no bigint, from_1904 boolean, cells array<struct<value:string,kind:string>>"
# Day zero of the two date systems.
DAY_ZERO = {False: "1899-12-30", True: "1904-01-01"}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_number(reference: str) -> int:
    """A cell's column from its reference, A1 giving 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _texts(element: ElementTree.Element) -> str:
    """The text runs of an item, phonetic hints left out."""
    if _name(element.tag) == "rPh":
        return ""
    own = element.text or "" if _name(element.tag) == "t" else ""
    return own + "".join(_texts(x) for x in element)


def _elements(stream, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of one name as the stream passes; each is emptied once it has been used."""
    parents = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if _name(element.tag) == wanted:
            yield element
            element.clear()
            if parents:
                parents[-1].remove(element)


def _sheets(archive: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, member) of the sheets in order, and whether dates count from 1904."""
    targets = {}
    with archive.open("xl/_rels/workbook.xml.rels") as raw:
        for r in _elements(raw, "Relationship"):
            targets[r.get("Id")] = posixpath.normpath(posixpath.join("/xl", r.get("Target"))).lstrip("/")
    found, late = [], False
    with archive.open("xl/workbook.xml") as raw:
        for _, e in ElementTree.iterparse(raw):
            if _name(e.tag) == "sheet":
                link = next((v for k, v in e.attrib.items() if _name(k) == "id"), None)
                found.append((e.get("name"), targets.get(link)))
            elif _name(e.tag) == "workbookPr":
                late = e.get("date1904") in ("1", "true")
    return [(n, m) for n, m in found if m in archive.namelist()], late


def _shared(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    with archive.open("xl/sharedStrings.xml") as raw:
        return [_texts(e) for e in _elements(raw, "si")]


def _value(cell: ElementTree.Element, shared: list[str]) -> dict | None:
    """A cell's text and kind: s text, n number, b truth."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return {"value": "".join(_texts(x) for x in cell if _name(x.tag) == "is"), "kind": "s"}
    value = next((x.text for x in cell if _name(x.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return {"value": shared[int(value)], "kind": "s"}
    return {"value": value, "kind": kind if kind in ("n", "b") else "s"}


def sheet_rows(files: DataFrame, sheet: str = r".*") -> DataFrame:
    """(path, sheet, row_no, from_1904, cells): the rows of matching sheets of workbooks given as rows (path, content).

    A cell is its text as stored (numbers and dates as a number) and its kind, s, n or b; empty cells and errors are
    missing. Rows that a sheet leaves out are left out here; row_no is the sheet's own. A file that is no workbook is an error.
    """
    pattern = re.compile(sheet)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    sheets, late = _sheets(archive)
                    shared = _shared(archive)
                    for name, member in sheets:
                        if not pattern.fullmatch(name):
                            continue
                        numbers, rows, at_row = [], [], 0
                        with archive.open(member) as raw:
                            for row in _elements(raw, "row"):
                                at_row = int(row.get("r") or at_row + 1)
                                cells: list[dict | None] = []
                                for n, c in enumerate(x for x in row if _name(x.tag) == "c"):
                                    at = column_number(c.get("r")) if c.get("r") else n
                                    cells += [None] * (at + 1 - len(cells))
                                    cells[at] = _value(c, shared)
                                numbers.append(at_row)
                                rows.append(cells)
                                if len(rows) == BATCH_ROWS:
                                    yield pd.DataFrame({"path": path, "sheet": name, "row_no": numbers, "from_1904": late, "cells": rows})
                                    numbers, rows = [], []
                        if rows:
                            yield pd.DataFrame({"path": path, "sheet": name, "row_no": numbers, "from_1904": late, "cells": rows})

    return files.select("path", "content").mapInPandas(unpack, ROWS)


def _typed(cell: Column, spec: str, late: Column) -> Column:
    """A cell by its informat; a number is taken as it is, and counts days where a date is due."""
    text, number = cell["value"], cell["kind"] == "n"
    name, _, _ = split_spec(spec)
    read = informat(text, spec)
    if spec.strip().startswith("$") or name.startswith("CHAR"):
        return read
    value = text.try_cast("double")
    zero = F.when(late, F.lit(DAY_ZERO[True])).otherwise(F.lit(DAY_ZERO[False])).cast("date")
    if name == "DATETIME":
        seconds = F.round(value * 86400).cast("bigint")
        at = F.timestamp_seconds(F.unix_timestamp(zero.cast("timestamp")) + seconds)
        return F.when(number, at).otherwise(read)
    if name in DATE_ORDERS:
        return F.when(number, F.date_add(zero, F.floor(value).cast("int"))).otherwise(read)
    return F.when(number, value).otherwise(read)


def sheet_table(rows: DataFrame, layout: list[tuple[str, str]], first_line: int = 2, first_column: int = 0) -> DataFrame:
    """Typed columns of sheet rows from `first_line` on, by position; short rows give missing values."""
    inside = rows.where(F.col("row_no") >= first_line)
    return inside.select(*[
        _typed(F.get("cells", F.lit(first_column + i)), spec, F.col("from_1904")).alias(name) for i, (name, spec) in enumerate(layout)
    ])


def read_workbooks(
    spark: SparkSession, path: str, layout: list[tuple[str, str]], sheet: str = r".*", first_line: int = 2
) -> DataFrame:
    """Typed rows of the matching sheets of all workbooks in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return sheet_table(sheet_rows(files, sheet), layout, first_line)


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _letters(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(column: int, row: int, value) -> str:
    if value is None or value != value:
        return ""
    at = f'r="{_letters(column)}{row}"'
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {at}><v>{value!r}</v></c>"
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _book(columns: list[str], records: list[tuple], sheet: str) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>'
                   f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">'
                   f'<Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_MAIN} xmlns:r="{_LINKS}"><sheets>'
                   f'<sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">'
                   f'<Relationship Id="rId1" Type="{_LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f"{_HEAD}<worksheet {_MAIN}><sheetData>".encode())
            for n, record in enumerate([columns, *records], start=1):
                cells = "".join(_cell(i, n, v) for i, v in enumerate(record))
                out.write(f'<row r="{n}">{cells}</row>'.encode())
            out.write(b"</sheetData></worksheet>")
    return buffer.getvalue()


def workbooks(df: DataFrame, name: str = "part", sheet: str = "data", rows: int = 100_000) -> DataFrame:
    """(path, content): the rows of `df` as workbooks of at most `rows` rows below a header line, made by the tasks that hold them.

    Dates and other kinds become their text. Numbering is by task and workbook, so names differ.
    """
    if not 0 < rows < SHEET_ROWS:
        raise ValueError(f"a sheet holds a header and fewer than {SHEET_ROWS} rows")
    plain = {"string", "boolean", "double", "float", "bigint", "int", "smallint", "tinyint"}
    text = df.select(F.spark_partition_id().alias("_task"), *[c if t in plain else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
    columns = df.columns

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, book, task = [], 0, 0
        for batch in batches:
            if len(batch):
                task = int(batch["_task"].iloc[0])
            data = batch[columns].astype(object).where(batch[columns].notna(), None)
            held += data.itertuples(index=False, name=None)
            while len(held) >= rows:
                yield pd.DataFrame({"path": [f"{name}-{task:05d}-{book:05d}.xlsx"], "content": [_book(columns, held[:rows], sheet)]})
                held, book = held[rows:], book + 1
        if held:
            yield pd.DataFrame({"path": [f"{name}-{task:05d}-{book:05d}.xlsx"], "content": [_book(columns, held, sheet)]})

    return text.mapInPandas(pack, "path string, content binary")
