"""Workbooks written, read back, and read as other programs write them."""

import datetime
import io
import zipfile

import pytest

from ledgerlift.sources import workbooks as W

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, shared=(), late=False):
    """A workbook with shared texts, as spreadsheet programs write it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        links = "".join(f'<Relationship Id="rId{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><workbookPr date1904="{int(late)}"/><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://x">{links}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}>' + "".join(f"<si>{t}</si>" for t in shared) + "</sst>")
        for i, data in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{data}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture(scope="module")
def files(spark):
    shared = ["<t>name</t>", "<r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh>", "<t>1.234,50</t>"]
    data = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c></row>'
        '<row r="3"><c r="B3" t="s"><v>1</v></c><c r="D3"><v>2.5</v></c><c r="E3" t="e"><v>#N/A</v></c><c r="F3" t="b"><v>1</v></c></row>'
        '<row><c t="s"><v>2</v></c><c><v>45000.25</v></c><c t="str"><v>made</v></c></row><row r="9"/>'
    )
    rows = [("a.xlsx", book({"one": data, "other": '<row r="1"><c r="AB1"><v>7</v></c></row>'}, shared)),
            ("b.xlsx", book({"one": '<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>1.5</v></c></row>'}, late=True))]
    return spark.createDataFrame(rows, "path string, content binary")


def test_cells_are_read_where_they_stand(files):
    got = {(r.path, r.sheet, r.row_no): [c and (c.value, c.kind) for c in r.cells] for r in W.sheet_rows(files).collect()}
    assert got == {
        ("a.xlsx", "one", 1): [("name", "s")],
        ("a.xlsx", "one", 3): [None, ("rich", "s"), None, ("2.5", "n"), None, ("1", "b")],
        ("a.xlsx", "one", 4): [("1.234,50", "s"), ("45000.25", "n"), ("made", "s")],
        ("a.xlsx", "one", 9): [],
        ("a.xlsx", "other", 1): [None] * 27 + [("7", "n")],
        ("b.xlsx", "one", 2): [("1", "n"), ("1.5", "n")],
    }
    assert W.sheet_rows(files, "oth.*").count() == 1
    assert W.sheet_rows(files.limit(0)).count() == 0


def test_layout_types_cells_by_kind(files):
    rows = W.sheet_rows(files, "one")
    table = W.sheet_table(rows, [("amount", "COMMAX13."), ("day", "DDMMYY10."), ("word", "$CHAR3.")], first_line=2)
    day = datetime.date
    assert sorted(map(tuple, table.where("amount is not null").collect())) == [(1.0, day(1904, 1, 2), None), (1234.5, day(2023, 3, 15), "mad")]
    at = W.sheet_table(rows, [("x", "$CHAR9."), ("at", "DATETIME20.")], first_line=2).where("x like '1.234%'").first()["at"]
    assert at == datetime.datetime(2023, 3, 15, 6, 0)


def test_written_workbooks_come_back_whole(spark, tmp_path):
    rows = [(i, i / 4, f"t<{i}>&\"' é\n\x01", i % 2 == 0, datetime.date(2020, 1, 1 + i)) for i in range(25)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n long, x double, t string, b boolean, d date").repartition(2)
    packed = W.workbooks(df, rows=7).collect()
    assert len({r.path for r in packed}) == len(packed) >= 4
    for r in packed:
        (tmp_path / r.path).write_bytes(r.content)
    layout = [("n", "BEST12."), ("x", "BEST12."), ("t", "$CHAR40."), ("b", "BEST1."), ("d", "$CHAR10.")]
    back = sorted(W.read_workbooks(spark, str(tmp_path), layout).collect(), key=lambda r: (r.n is not None, r.n))
    assert [(r.n, r.x, r.t, r.b, r.d) for r in back[-25:]] == [
        (i, i / 4, t.replace("\x01", "").rstrip(" "), float(b), str(d)) for i, _, t, b, d in rows[:-1]]
    with pytest.raises(ValueError):
        W.workbooks(df, rows=W.SHEET_ROWS)


def test_column_letters():
    assert [W.column_number(W._letters(i) + "7") for i in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]
