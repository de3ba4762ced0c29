"""Statements for target platforms, and converted steps that are run."""

import os

import pytest

from ledgerlift.operators import convert as C
from ledgerlift.operators import statements as T

COLUMNS = [
    ("pol", 1, "ID", "num", 8, "", "Policy's id"),
    ("pol", 0, "Start", "num", 8, "DATE9.", ""),
    ("pol", 2, "net premium", "num", 8, "COMMAX20.2", "a \\ b"),
    ("pol", 3, "Name", "char", 20, "$CHAR20.", None),
    ("odd-name", 0, "x", "char", 0, "", ""),
]


@pytest.fixture(scope="module")
def meta(spark):
    datasets = spark.createDataFrame([("pol", 3), ("odd-name", -1), ("empty", None)], "dataset_name string, row_count long")
    columns = spark.createDataFrame(COLUMNS, "dataset_name string, position int, name string, type string, length int, format string, label string")
    return datasets, columns


def by_name(df):
    return {r.dataset_name: r.statement for r in df.collect()}


def test_create_statements_quote_what_needs_it(meta):
    lake, house = by_name(T.create_statements(*meta)), by_name(T.create_statements(*meta, "warehouse", "DB.RAW"))
    assert lake["pol"] == (
        "CREATE TABLE IF NOT EXISTS bronze.pol (\n  start DATE,\n  id DOUBLE COMMENT 'Policy\\'s id',\n"
        "  `net premium` DECIMAL(20,2) COMMENT 'a \\\\ b',\n  name STRING\n)"
    )
    assert house["pol"] == (
        "CREATE TABLE IF NOT EXISTS DB.RAW.POL (\n  START DATE,\n  ID NUMBER(38,10) COMMENT 'Policy''s id',\n"
        "  \"NET PREMIUM\" NUMBER(38,10) COMMENT 'a \\ b',\n  NAME VARCHAR(20)\n)"
    )
    assert lake["odd-name"].startswith("CREATE TABLE IF NOT EXISTS bronze.`odd-name` (") and lake["empty"] is None


def test_created_tables_load_and_pass_their_checks(spark, meta, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS stm LOCATION '%s'" % (tmp_path / "stm"))
    try:
        spark.sql(by_name(T.create_statements(*meta, namespace="stm", provider="parquet"))["pol"])
        spark.sql("INSERT INTO stm.pol VALUES (DATE'2020-01-01', 1, 2.5, 'a'), (DATE'2020-01-02', 2, NULL, 'b'), (NULL, 4, 3, 'c')")
        assert [c.description for c in spark.catalog.listColumns("stm.pol") if c.name == "id"] == ["Policy's id"]
        checks = {r.kind: r.statement for r in T.check_statements(*meta, namespace="stm").where("dataset_name = 'pol'").collect()}
        assert set(checks) == {"row_count", "schema", "column_stats", "checksum"}
        assert spark.sql(checks["row_count"]).first().asDict() == {
            "dataset": "pol", "check_name": "row_count", "expected": 3, "actual": 3, "status": "PASS"}
        stats = spark.sql(checks["column_stats"]).first()
        assert (stats["min_id"], stats["max_id"], stats["nulls_id"], stats["nulls_start"], stats["nulls_net premium"]) == (1, 4, 0, 1, 1)
        assert spark.sql(checks["checksum"]).first()["checksum"] is not None
    finally:
        spark.sql("DROP DATABASE stm CASCADE")


def test_checks_of_the_unknown_give_no_verdict(meta):
    rows = [r for r in T.check_statements(*meta).collect() if r.dataset_name != "pol"]
    kinds = {(r.dataset_name, r.kind) for r in rows}
    assert kinds == {("odd-name", "row_count"), ("odd-name", "schema"), ("odd-name", "checksum"), ("empty", "row_count"), ("empty", "schema")}
    assert all("'UNKNOWN' AS status" in r.statement for r in rows if r.kind == "row_count")


def test_loads_and_written_files(spark, meta, tmp_path):
    datasets, columns = meta
    assert by_name(T.load_statements(datasets, "warehouse", "DB.RAW", "/stage", True))["pol"].startswith("CREATE OR REPLACE PIPE DB.RAW.PIPE_POL\n")
    assert "FROM '/landing/pol.csv'" in by_name(T.load_statements(datasets))["pol"]
    T.write_statements(T.create_statements(datasets, columns).unionByName(T.load_statements(datasets)), str(tmp_path / "out"))
    assert {d for d in os.listdir(tmp_path / "out") if "=" in d} == {"kind=create", "kind=load"}
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text.count("COPY INTO") == 3 and text.count("CREATE TABLE") == 2
    assert T.create_statements(datasets.limit(0), columns.limit(0)).count() == 0


PROGRAM = """
LIBNAME raw '/d/raw';  LIBNAME gone "/x";
/* proc sort data=raw.no; by x; run; */
%MACRO report(m);
%MEND;
proc sort data=raw.people out=work.firsts nodupkey; by city descending age; run;
PROC SORT DATA=raw.people OUT=ordered; BY DESCENDING age name; RUN;
data work.grown (keep=name age); set raw.people; where age >= 18; run;
data work.every; set raw.people raw.others; run;
data work.joined; merge work.firsts (in=a) raw.cities (in=b); by city; if a; run;
data work.both; merge work.firsts (in=a) raw.cities (in=b); by city; if a and b; drop mayor; run;
data work.calc; set raw.people; age2 = age * 2; run;
data work.h; if _n_ = 1 then do; declare hash h(dataset: "raw.x"); end; set raw.people; run;
PROC SQL; CREATE TABLE work.q AS SELECT p.city, count(*) AS n FROM raw.people p GROUP BY p.city; SELECT max(age) INTO :m FROM raw.people; QUIT;
PROC FREQ DATA=raw.people; TABLES city city*age / nocum; RUN;
PROC MEANS DATA=raw.people; CLASS city; VAR age; RUN;
PROC UNIVARIATE DATA=raw.people; VAR age; RUN;
PROC FORMAT; VALUE $sx 'm'='male' 'f'='female'; VALUE ag 0-17='young' 18-HIGH='old'; RUN;
PROC EXPORT DATA=work.grown OUTFILE="/export" DBMS=CSV replace; RUN;
PROC IMPORT DATAFILE="/in/a.xlsx" OUT=work.imp DBMS=XLSX; RUN;
PROC LOGISTIC DATA=raw.people; MODEL y = x; RUN;
PROC PRINT DATA=raw.people; RUN;
PROC FREQ DATA=raw.people; RUN;
"""
PEOPLE = [("ann", "rome", 30), ("bob", "rome", 10), ("cid", "oslo", 20), ("dee", "oslo", 50), ("eve", "bern", 18)]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("export")
    rows = [(1, "a.sas", PROGRAM.replace("/export", str(out))), (2, "none.sas", "x = 1;"), (3, "null.sas", None)]
    programs = spark.createDataFrame(rows, "program_id long, filename string, content string")
    spark.createDataFrame(PEOPLE, "name string, city string, age int").createOrReplaceTempView("people")
    spark.createDataFrame([("zoe", "bern", 1)], "name string, city string, age int").createOrReplaceTempView("others")
    spark.createDataFrame([("rome", "x"), ("nice", "y")], "city string, mayor string").createOrReplaceTempView("cities")
    return C.convert_steps(programs, {"work": "", "raw": ""}, "TEMP VIEW").cache(), out


def test_steps_come_in_order_with_a_status(steps):
    rows = [(r.kind, r.part, r.status) for r in steps[0].orderBy("place", "part").collect()]
    assert rows == [
        ("LIBNAME", 1, "converted"), ("LIBNAME", 1, "review"), ("MACRO", 1, "review"), ("SORT", 1, "converted"), ("SORT", 1, "converted"),
        ("DATA", 1, "converted"), ("DATA", 1, "converted"), ("MERGE", 1, "converted"), ("MERGE", 1, "converted"), ("DATA", 1, "review"),
        ("DATA", 1, "gap"), ("SQL", 1, "converted"), ("SQL", 2, "review"), ("FREQ", 1, "converted"), ("FREQ", 2, "converted"),
        ("MEANS", 1, "converted"), ("UNIVARIATE", 1, "converted"), ("FORMAT", 1, "converted"), ("FORMAT", 2, "review"),
        ("EXPORT", 1, "converted"), ("IMPORT", 1, "gap"), ("LOGISTIC", 1, "gap"), ("PRINT", 1, "review"), ("FREQ", 1, "review"),
    ]
    notes = {(r.kind, r.part): r.note for r in steps[0].where("status <> 'converted'").collect() if r.kind not in ("LIBNAME",)}
    assert notes["DATA", 1] in ("left: age2 = age * 2;", "hash object: join with the lookup table")
    assert notes["IMPORT", 1] == "files of kind XLSX need another reader"


def test_converted_steps_run(spark, steps):
    got = []
    for r in steps[0].where("status = 'converted' and statement is not null").orderBy("place", "part").collect():
        got.append(spark.sql(r.statement).collect())
    rows = lambda name: sorted(tuple(r) for r in spark.table(name).collect())
    assert {r.city for r in spark.table("firsts").collect()} == {"rome", "oslo", "bern"}
    assert len(rows("firsts")) == 5  # the key is (city, age)
    assert [r.age for r in spark.table("ordered").collect()] == [50, 30, 20, 18, 10]
    assert rows("grown") == [("ann", 30), ("cid", 20), ("dee", 50), ("eve", 18)]
    assert len(rows("every")) == 6
    assert sorted((r.city, r.mayor) for r in spark.table("joined").collect()) == [("bern", None), ("oslo", None), ("oslo", None), ("rome", "x"), ("rome", "x")]
    assert spark.table("both").columns == ["city", "name", "age"] and len(rows("both")) == 2
    assert rows("q") == [("bern", 1), ("oslo", 2), ("rome", 2)]
    assert rows("format_sx") == [("f", "female"), ("m", "male")]
    freq = next(g for g in got if g and "frequency" in g[0].asDict())
    assert [(r.city, r.frequency, float(r.percent)) for r in freq] == [("oslo", 2, 40.0), ("rome", 2, 40.0), ("bern", 1, 20.0)]
    spread = next(g for g in got if g and "age_median" in g[0].asDict())[0]
    assert (spread.age_n, spread.age_p25, spread.age_median, spread.age_p75) == (5, 18.0, 20.0, 30.0)
    assert len(spark.read.option("header", True).csv(str(steps[1])).collect()) == 4


def test_programs_become_scripts(steps):
    rows = C.converted_programs(steps[0]).collect()
    assert [r.program_id for r in rows] == [1]  # the others have no steps
    r = rows[0]
    assert (r.statements, r.converted, r.review, r.gap, r.share) == (24, 14, 7, 3, 58.3)
    assert r.script.startswith("-- line 2, LIBNAME\n\n-- line 2, LIBNAME: review, no schema for library gone\n\n-- line 4, MACRO")
    assert "-- line 21, LOGISTIC: gap, no counterpart of LOGISTIC in SQL" in r.script


def test_libraries_name_schemas(spark):
    text = "LIBNAME raw '/d'; PROC SORT DATA=RAW.t OUT=dw.s; BY id; RUN; PROC SQL; CREATE TABLE dw.q AS SELECT * FROM raw.t; QUIT;"
    programs = spark.createDataFrame([(1, "a", text)], "program_id long, filename string, content string")
    got = [r.statement for r in C.convert_steps(programs, {"raw": "main.bronze", "dw": "main.gold"}).orderBy("place").collect()]
    assert got == [
        "USE main.bronze", "CREATE OR REPLACE TABLE main.gold.s AS SELECT * FROM main.bronze.t ORDER BY id",
        "CREATE OR REPLACE TABLE main.gold.q AS SELECT * FROM main.bronze.t",
    ]
