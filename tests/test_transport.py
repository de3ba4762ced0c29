"""Transport files: numbers, layouts and rows, from bytes laid out by hand and from files written here."""

import datetime
import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerlift.sources import transport as P


@given(st.lists(st.floats(min_value=-1e70, max_value=1e70, allow_nan=False).filter(lambda x: x == 0 or abs(x) > 1e-70), min_size=1, max_size=20))
def test_numbers_come_back(values):
    raw = P.from_numbers(np.array(values))
    assert P.to_numbers(raw).tolist() == [x if x else 0.0 for x in values]


def test_numbers_as_the_format_writes_them():
    known = {1.0: "4110000000000000", -118.625: "c276a00000000000", 0.1: "401999999999999a", 100.0: "4264000000000000", 0.0: "0" * 16}
    for value, text in known.items():
        assert P.from_numbers(np.array([value])).tobytes().hex() == text
        assert P.to_numbers(np.frombuffer(bytes.fromhex(text), np.uint8).reshape(1, 8))[0] == value
    short = np.frombuffer(bytes.fromhex("411000"), np.uint8).reshape(1, 3)
    assert P.to_numbers(short)[0] == 1.0
    for mark in (b".", b"_", b"A", b"Z"):
        assert np.isnan(P.to_numbers(np.frombuffer(mark.ljust(8, b"\x00"), np.uint8).reshape(1, 8))[0])
    with pytest.raises(ValueError):
        P.from_numbers(np.array([1e300]))


def by_hand(*sets):
    """A file whose records are laid out here, not by the library."""
    pad = lambda b: b + b" " * (-len(b) % 80)
    head = lambda kind, tail="0" * 30: pad(f"HEADER RECORD*******{kind:<8}HEADER RECORD!!!!!!!{tail}".encode())
    out = head("LIBRARY") + pad(b"SAS     SAS     SASLIB  6.06") + pad(b"01JAN20:00:00:00")
    for name, label, variables, rows in sets:
        out += head("MEMBER", "000000000000000001600000000140") + head("DSCRPTR")
        out += pad(b"SAS     " + name.encode().ljust(8) + b"SASDATA 6.06") + pad(b"01JAN20:00:00:00" + b" " * 16 + label.encode().ljust(40))
        out += head("NAMESTR", f"000000{len(variables):04d}" + "0" * 20)
        place, described = 0, b""
        for i, (v, kind, length, form, width) in enumerate(variables, 1):
            described += struct.pack(">hhhh8s40s8shhh2s8shhl52s", kind, 0, length, i, v.encode().ljust(8), f"about {v}".encode().ljust(40),
                                     form.encode().ljust(8), width, 0, 0, b"", b" " * 8, 0, 0, place, b"")
            place += length
        out += pad(described) + head("OBS") + pad(b"".join(rows))
    return out


@pytest.fixture(scope="module")
def files(spark):
    num = lambda x: P.from_numbers(np.array([float(x)])).tobytes()
    one = ("ONE", "first set", [("ID", 1, 3, "", 0), ("WHEN", 1, 8, "DDMMYY", 10), ("TXT", 2, 5, "$CHAR", 5)],
           [num(1)[:3] + num(0) + b"ab   ", num(7)[:3] + num(366) + "é".encode("cp1252") + b"    ", b".\x00\x00" + b"." + b"\x00" * 7 + b"     "])
    two = ("TWO", "", [("S", 2, 2, "", 0)], [b"x ", b"  ", b"y "])
    none = ("NONE", "", [("N", 1, 8, "", 0)], [])
    return spark.createDataFrame([("a.xpt", by_hand(one, none, two)), ("b.xpt", by_hand(two))], "path string, content binary")


def test_metadata_of_all_data_sets(files):
    got = {(r.path, r.dataset_name): r for r in P.member_meta(files).collect()}
    assert {k: (r.label, r.row_count, r.column_count) for k, r in got.items()} == {
        ("a.xpt", "ONE"): ("first set", 3, 3), ("a.xpt", "NONE"): ("", 0, 1), ("a.xpt", "TWO"): ("", 3, 1), ("b.xpt", "TWO"): ("", 3, 1)}
    assert [tuple(c) for c in got["a.xpt", "ONE"].columns] == [
        (0, "ID", "num", 3, "", "about ID"), (1, "WHEN", "num", 8, "DDMMYY10.", "about WHEN"), (2, "TXT", "char", 5, "$CHAR5.", "about TXT")]


def test_rows_of_a_data_set(spark, files, tmp_path):
    for r in files.collect():
        (tmp_path / r.path).write_bytes(r.content)
    one = sorted(P.read_transport(spark, str(tmp_path), "ONE").collect(), key=str)
    day = datetime.date
    assert [tuple(r) for r in one] == [(1.0, day(1960, 1, 1), "ab"), (7.0, day(1961, 1, 1), "é"), (None, None, "")]
    assert sorted(r.s for r in P.read_transport(spark, str(tmp_path), "TWO").collect()) == ["", "", "x", "x", "y", "y"]
    with pytest.raises(ValueError):
        P.read_transport(spark, str(tmp_path), "THREE")


def test_written_files_come_back(spark):
    rows = [(i, i / 7, datetime.date(1950 + i, 3, 1), datetime.datetime(2020, 1, 1, 5, 6, 7) + datetime.timedelta(days=i), f"text {i}") for i in range(40)]
    rows.append((None, None, None, None, None))
    df = spark.createDataFrame(rows, "n int, x double, d date, at timestamp_ntz, t string").repartition(3)
    packed = P.transport_of(df, "MINE", widths={"t": 7}).cache()
    meta = P.member_meta(packed).collect()
    assert sum(r.row_count for r in meta) == 41 and [c.format for c in meta[0].columns] == ["", "", "DATE9.", "DATETIME20.", ""]
    back = P.member_table(P.member_rows(packed), [c.asDict() for c in meta[0].columns]).collect()
    want = [(float(n), x, d, at, t[:7]) for n, x, d, at, t in rows[:-1]] + [(None, None, None, None, "")]
    assert sorted(map(tuple, back), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        P.transport_of(df.withColumnRenamed("n", "muchtoolong"), "MINE")


def test_other_files_are_refused(spark):
    bad = spark.createDataFrame([("a.xpt", b"no such thing")], "path string, content binary")
    with pytest.raises(Exception, match="not a transport file"):
        P.member_meta(bad).collect()
