"""Checks after a load."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.operators import reconcile as V
from ledgerlift.plans.views import view, with_views


def _pair(s, d):
    """Customers against a copy that lost rows, gained a column and changed a type."""
    src = view(s, d, "customer")
    dst = src.where("c_custkey % 97 <> 5").withColumn("c_nationkey", F.col("c_nationkey").cast("bigint")).withColumn("loaded", F.lit(1)).drop("c_name")
    return src, dst


def _reordered(s, d):
    src = view(s, d, "lineitem")
    return src, src.repartition(5, "l_partkey")


def _library(s, d):
    """The described library, and one that lost datasets, columns and rows, got others and changed types."""
    datasets, columns = view(s, d, "datasets_meta"), view(s, d, "columns_meta")
    kept = columns.where("dataset_name not like 'mystery%'")
    retyped = F.when(F.col("length") % 13 == 2, "text").otherwise(F.col("type"))
    lost = kept.where("length % 17 <> 5").select("dataset_name", F.upper("name").alias("name"), retyped.alias("type"))
    new = kept.where("length % 19 = 4").select("dataset_name", F.concat("name", F.lit("_new")).alias("name"), "type")
    loaded = datasets.where("dataset_name not like 'mystery%'").select(
        "dataset_name", F.when(F.col("dataset_name").like("claims%"), F.col("row_count") - 1).otherwise(F.col("row_count")).alias("row_count"))
    return datasets, columns, loaded, lost.unionByName(new)


def _columns(s, d):
    _, columns, _, loaded = _library(s, d)
    return columns, loaded


def _datasets(s, d):
    datasets, _, loaded, _ = _library(s, d)
    return datasets, loaded


QUERIES = {
    "check_schema": lambda s, d: V.check_schemas(*_columns(s, d)),
    "check_row_counts": lambda s, d: V.check_row_counts(*_datasets(s, d)),
    "check_exists": lambda s, d: V.check_tables(*_datasets(s, d)),
    "reconcile_library": lambda s, d: V.reconcile_library(*_library(s, d)),
    "check_row_count": lambda s, d: V.check_row_count(*_pair(s, d), "customer"),
    "check_row_count_pass": lambda s, d: V.check_row_count(*_reordered(s, d), "lineitem"),
    "check_column_stats": lambda s, d: V.check_column_stats(*_pair(s, d), "customer"),
    "check_checksum": lambda s, d: V.check_checksum(*_reordered(s, d), "lineitem"),
    "checksum": lambda s, d: V.checksum(view(s, d, "lineitem")),
    "reconcile": lambda s, d: V.reconcile(*_pair(s, d), "customer"),
}

COUNT = """SELECT 'customer' AS dataset, 'row_count' AS "check", '' AS "column", CAST((SELECT count(*) FROM customer) AS DOUBLE) AS expected,
  CAST((SELECT count(*) FROM dst) AS DOUBLE) AS actual, CASE WHEN (SELECT count(*) FROM customer) = (SELECT count(*) FROM dst) THEN 'PASS' ELSE 'FAIL' END AS status"""
DST = "dst AS (SELECT * FROM customer WHERE c_custkey % 97 <> 5)"
SCHEMA = """SELECT * FROM (VALUES ('customer', 'schema', '', 5.0e0, 5.0e0, 'PASS'), ('customer', 'schema_missing', 'c_name', 1.0e0, 0.0e0, 'FAIL'),
  ('customer', 'schema_extra', 'loaded', 0.0e0, 1.0e0, 'FAIL'), ('customer', 'schema_type', 'c_nationkey', 1.0e0, 1.0e0, 'FAIL'))
  v(dataset, "check", "column", expected, actual, status)"""
STATS = " UNION ALL ".join(
    f"""SELECT 'customer' AS dataset, '{n}' AS "check", '{c}' AS "column", e AS expected, a AS actual, CASE WHEN e = a THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT CAST({f.format(c)} AS DOUBLE) AS e FROM customer), (SELECT CAST({f.format(c)} AS DOUBLE) AS a FROM dst)"""
    for c in ("c_custkey", "c_nationkey", "c_acctbal")
    for n, f in (("min", "min({0})"), ("max", "max({0})"), ("avg", "round(avg({0}), 6)"), ("null_count", "count(*) - count({0})")))

LOADED = """ac AS (SELECT dataset_name, upper(name) AS name, CASE WHEN length % 13 = 2 THEN 'text' ELSE type END AS type FROM columns_meta
    WHERE dataset_name NOT LIKE 'mystery%' AND length % 17 <> 5
  UNION ALL SELECT dataset_name, name || '_new', type FROM columns_meta WHERE dataset_name NOT LIKE 'mystery%' AND length % 19 = 4),
ad AS (SELECT dataset_name, CASE WHEN dataset_name LIKE 'claims%' THEN row_count - 1 ELSE row_count END AS row_count
  FROM datasets_meta WHERE dataset_name NOT LIKE 'mystery%')"""
SCHEMAS = """SELECT dataset, 'schema' AS "check", '' AS "column", CAST(sum(e) AS DOUBLE) AS expected, CAST(sum(a) AS DOUBLE) AS actual,
    CASE WHEN sum(e) = sum(a) THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT dataset_name AS dataset, 1 AS e, 0 AS a FROM columns_meta UNION ALL SELECT dataset_name, 0, 1 FROM ac) GROUP BY dataset
UNION ALL SELECT dataset_name, 'schema_missing', name, 1, 0, 'FAIL' FROM columns_meta c
  WHERE NOT EXISTS (SELECT 1 FROM ac WHERE ac.dataset_name = c.dataset_name AND lower(ac.name) = lower(c.name))
UNION ALL SELECT dataset_name, 'schema_extra', name, 0, 1, 'FAIL' FROM ac
  WHERE NOT EXISTS (SELECT 1 FROM columns_meta c WHERE ac.dataset_name = c.dataset_name AND lower(ac.name) = lower(c.name))
UNION ALL SELECT c.dataset_name, 'schema_type', c.name, 1, 1, 'FAIL' FROM columns_meta c JOIN ac ON ac.dataset_name = c.dataset_name
  AND lower(ac.name) = lower(c.name) WHERE ac.type <> c.type"""
COUNTS = """SELECT d.dataset_name AS dataset, 'row_count' AS "check", '' AS "column", CAST(CASE WHEN d.row_count >= 0 THEN d.row_count END AS DOUBLE) AS expected,
    CAST(ad.row_count AS DOUBLE) AS actual, CASE WHEN coalesce(d.row_count, -1) < 0 THEN 'UNKNOWN' WHEN d.row_count = ad.row_count THEN 'PASS' ELSE 'FAIL' END AS status
  FROM datasets_meta d LEFT JOIN ad ON ad.dataset_name = d.dataset_name"""
EXISTS = """SELECT dataset_name AS dataset, 'exists' AS "check", '' AS "column", 1.0e0 AS expected,
    CASE WHEN dataset_name LIKE 'mystery%' THEN 0.0e0 ELSE 1.0e0 END AS actual,
    CASE WHEN dataset_name LIKE 'mystery%' THEN 'WARNING' ELSE 'PASS' END AS status FROM datasets_meta"""


def _lib(sql):
    return with_views("columns_meta datasets_meta", f"WITH {LOADED} {sql}")


ORACLE = {
    "check_schema": _lib(SCHEMAS),
    "check_row_counts": _lib(COUNTS),
    "check_exists": _lib(EXISTS),
    "reconcile_library": _lib(f"{EXISTS} UNION ALL {COUNTS} UNION ALL {SCHEMAS}"),
    "check_row_count": f"WITH {DST} {COUNT}",
    "check_row_count_pass": """SELECT 'lineitem' AS dataset, 'row_count' AS "check", '' AS "column", CAST(count(*) AS DOUBLE) AS expected,
      CAST(count(*) AS DOUBLE) AS actual, 'PASS' AS status FROM lineitem""",
    "check_column_stats": f"WITH {DST} {STATS}",
    "check_checksum": """SELECT 'lineitem' AS dataset, 'checksum' AS "check", '' AS "column", CAST(NULL AS DOUBLE) AS expected, CAST(NULL AS DOUBLE) AS actual, 'PASS' AS status""",
    "reconcile": f"""WITH {DST} {COUNT} UNION ALL {SCHEMA} UNION ALL {STATS}
      UNION ALL SELECT 'customer', 'checksum', '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'FAIL'""",
}
