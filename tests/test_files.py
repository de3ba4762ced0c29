import datetime as dt
import json
import os
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators.reconcile import check_row_count, checksum, reconcile
from ledgerlift.session import scratch, stored
from ledgerlift.sources import files as X
from ledgerlift.streaming.ingest import ingest

LAYOUT = [("id", "BEST12."), ("day", "DDMMYY10."), ("amount", "COMMAX13."), ("name", "$CHAR4.")]
TEXT = "id;day;amount;name\n1;31/12/2024;1.234,50;abcdef\nx;31/02/2024;oops;\n3;01/01/2025\n"
WANT = [(1.0, dt.date(2024, 12, 31), 1234.5, "abcd"), (None, None, None, None), (3.0, dt.date(2025, 1, 1), None, None)]


def write(path, text, mode="w", **kw):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, **kw) as f:
        f.write(text)


def test_delimited_with_bad_fields_and_short_rows(spark, tmp_path):
    write(f"{tmp_path}/in/a.txt", TEXT)
    assert [tuple(r) for r in X.read_delimited(spark, f"{tmp_path}/in", LAYOUT).collect()] == WANT


def test_delimited_encoding(spark, tmp_path):
    write(f"{tmp_path}/in/a.txt", "id;day;amount;name\n1;;;Aç€ã\n", encoding="cp1252")
    assert X.read_delimited(spark, f"{tmp_path}/in", LAYOUT, encoding="windows-1252").first()["name"] == "Aç€ã"


def test_zip_members(spark, tmp_path):
    os.makedirs(f"{tmp_path}/z")
    with zipfile.ZipFile(f"{tmp_path}/z/a.zip", "w") as z:
        z.writestr("data.txt", TEXT)
        z.writestr("other.md", "no")
    got = X.read_zip_members(spark, f"{tmp_path}/z", LAYOUT, r".*\.txt")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(WANT, key=str)


def test_scan_excludes_and_depth(spark, tmp_path):
    root = f"{tmp_path}/code"
    write(f"{root}/a.sas", "one\ntwo")
    write(f"{root}/sub/B.SAS", "x\r\ny\r\n")
    write(f"{root}/backup/old.sas", "x")
    write(f"{root}/sub/old_1.sas", "x")
    write(f"{root}/1/2/3/deep.sas", "x")
    write(f"{root}/note.txt", "x")
    got = {(r["relative_path"], r["line_count"]) for r in X.scan_programs(spark, [root], ["backup", "old_*"], 3).collect()}
    assert got == {("a.sas", 2), ("sub/B.SAS", 2)}


def test_scan_datasets_logs_and_sidecars(spark, tmp_path):
    root = f"{tmp_path}/data"
    write(f"{root}/lib/t1.sas7bdat", "abc")
    write(f"{root}/lib/t2.xpt", "ab")
    write(f"{root}/lib/run.log", "log")
    meta = {"dataset_name": "t1", "row_count": 5, "column_count": 1, "size_bytes": 3,
            "columns": [{"name": "x", "type": "num", "length": 8, "format": "", "label": ""}]}
    write(f"{root}/lib/t1.sas7bdat.meta.json", json.dumps(meta, indent=2))
    found = {(r["dataset_name"], r["inferred_library"], r["file_type"], r["size_bytes"]) for r in X.scan_dataset_files(spark, [root]).collect()}
    assert found == {("t1", "lib", "sas7bdat", 3), ("t2", "lib", "xpt", 2)}
    assert [r["filename"] for r in X.scan_logs(spark, [root]).collect()] == ["run.log"]
    known = X.read_dataset_meta(spark, [root])
    assert {(r["dataset_name"], r["row_count"], len(r["columns"])) for r in known.collect()} == {("t1", 5, 1), ("t2", None, 0)}
    assert X.meta_columns(known).first()["name"] == "x"


def test_copy_into_skips_bad_rows_and_loaded_files(spark, tmp_path):
    src, table = f"{tmp_path}/src", f"{tmp_path}/table"
    write(f"{src}/1.csv", "a,b\n1,x\nbad,y\n2,z\n")
    assert X.copy_into(spark, src, table, "a int, b string") == 1
    assert X.copy_into(spark, src, table, "a int, b string") == 0
    write(f"{src}/2.csv", "a,b,c\n3,w,9\n")
    assert X.copy_into(spark, src, table, "a int, b string, c int") == 1
    got = sorted((r["a"], r["b"], r["c"]) for r in X.read_loaded(spark, table).collect())
    assert [g[:2] for g in got] == [(1, "x"), (2, "z"), (3, "w")] and got[2][2] == 9


def test_unlogged_load_is_invisible(spark, tmp_path):
    src, table = f"{tmp_path}/src", f"{tmp_path}/table"
    write(f"{src}/1.csv", "a\n1\n")
    X.copy_into(spark, src, table, "a int")
    spark.createDataFrame([(7,)], "a int").withColumns({"_bad": F.lit(None).cast("string"), "_file": F.lit("x")}).write.parquet(f"{table}/load_id=load-1")
    assert [r["a"] for r in X.read_loaded(spark, table).collect()] == [1]
    write(f"{src}/2.csv", "a\n2\n")
    X.copy_into(spark, src, table, "a int")
    assert sorted(r["a"] for r in X.read_loaded(spark, table).collect()) == [1, 2]


def test_two_loads_at_once_give_every_file_once(spark, tmp_path):
    src, table = f"{tmp_path}/src", f"{tmp_path}/table"
    for i in range(4):
        write(f"{src}/{i}.csv", f"a\n{i}\nbad\n")
    with ThreadPoolExecutor(2) as pool:
        counts = list(pool.map(lambda _: X.copy_into(spark, src, table, "a int"), range(2)))
    assert max(counts) == 4
    assert sorted(r["a"] for r in X.read_loaded(spark, table).collect()) == [0, 1, 2, 3]
    log = X.loaded_files(spark, table)
    assert {(r["good"], r["rejected"]) for r in log.collect()} == {(1, 1)}
    assert X.copy_into(spark, src, table, "a int") == 0


def test_loads_without_schema_and_without_new_columns(spark, tmp_path):
    src, table = f"{tmp_path}/src", f"{tmp_path}/table"
    with pytest.raises(ValueError):
        X.read_loaded(spark, table)
    write(f"{src}/1.csv", "a,b\n1,x\n")
    assert X.copy_into(spark, src, table) == 1
    assert dict(X.read_loaded(spark, table).dtypes) == {"a": "int", "b": "string"}
    write(f"{src}/2.csv", "a,b,c\n2,y,z\n")
    with pytest.raises(ValueError, match="'c'"):
        X.copy_into(spark, src, table, "a int, b string, c string", merge_schema=False)


def test_stream_reads_only_new_files(spark, tmp_path):
    src, table, check = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/check"
    write(f"{src}/1.csv", "a\n1\n2\n")
    assert ingest(spark, src, table, "a int", check).count() == 2
    write(f"{src}/2.csv", "a\n3\n")
    again = ingest(spark, src, table, "a int", check)
    assert sorted(r["a"] for r in again.collect()) == [1, 2, 3]


def test_stream_admits_a_new_column(spark, tmp_path):
    src, table, check = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/check"
    write(f"{src}/1.csv", "a\n1\n")
    ingest(spark, src, table, "a int", check)
    write(f"{src}/2.csv", "a,b\n2,x\n")
    got = ingest(spark, src, table, "a int, b string", check)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, None), (2, "x")]


def test_scratch_tables_go_with_their_block(spark):
    kept = stored(spark.range(3), "kept")
    with scratch(spark):
        inner = stored(spark.range(5), "inner")
        assert inner.count() == 5
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_checks(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(2, None), (1, 2.0)], "k int, v double")
    assert {r["status"] for r in reconcile(a, b, "t").collect()} == {"PASS"}
    assert check_row_count(a, b.unionAll(b), "t").first()["status"] == "FAIL"
    assert checksum(a.unionAll(a).unionAll(a)).first() != checksum(a).first()
