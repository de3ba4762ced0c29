"""Registered queries against their SQL at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlift.plans.views import BASE_TABLES

SF = "/root/testdata/sf0.001"
NAMES = [
    "aging_summary", "reserve_drag", "reserve_status", "journal", "freq_crosstab", "means_class", "univariate",
    "merge_by_full", "merge_by_many", "first_last", "fact_policies", "x_step_scopes", "complexity", "findings",
    "conciliation", "apply_schema_warehouse", "lineage_closure", "program_impact", "catalog_summary", "reconcile", "read_zip_member", "copy_into",
    "convert_steps", "converted_programs", "create_statements_lakehouse", "check_statements_warehouse", "load_statements_lakehouse_recurring",
    "check_schema", "reconcile_library", "read_workbooks", "read_transport", "scan_datasets", "scan_logs", "flow_ends",
]


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def place(row):
    """Sort key: whole values first, then numbers coarsely."""
    return [str(v) for v in row if not isinstance(v, float)], [round(v) if isinstance(v, float) else 0 for v in row]


def same(a, b):
    """Equal, or numbers apart by no more than one rounded-off digit."""
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4) if number(a) and number(b) else a == b


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=place)
    want = sorted(cur.fetchall(), key=place)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(same(a, b) for a, b in zip(g, w)), (g, w)
