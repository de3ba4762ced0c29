"""Type mapping and typed loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.operators import schema as M
from ledgerlift.plans.views import view, with_views


def _cols(s, d):
    return view(s, d, "columns_meta")


def _map(target, strict=False):
    return lambda s, d: M.map_types(_cols(s, d), target, strict).select("dataset_name", "position", "name", "target_type")


def _raw(s, d):
    """Orders as the source stores them: days and seconds since 1960, padded text."""
    return view(s, d, "orders").select(
        F.col("o_orderkey").cast("double").alias("ORDER_ID"),
        F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1960-01-01").cast("date")).cast("double").alias("ORDER_DAY"),
        (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.lit(M.SECONDS_TO_1970)).cast("double").alias("ORDER_AT"),
        F.col("o_totalprice").alias("TOTAL"), F.col("o_orderpriority").alias("PRIORITY"))


def _warehouse(s, d):
    return M.apply_schema(_raw(s, d), [
        {"name": "ORDER_ID", "type": "num", "target_type": "NUMBER(38,10)"},
        {"name": "ORDER_DAY", "type": "num", "target_type": "DATE"},
        {"name": "ORDER_AT", "type": "num", "target_type": "TIMESTAMP_NTZ"},
        {"name": "TOTAL", "type": "num", "target_type": "NUMBER(20,2)"},
        {"name": "PRIORITY", "type": "char", "target_type": "VARCHAR(3)"},
    ]).withColumns({c: F.col(c).cast("double") for c in ("order_id", "total")})


def _apply(s, d):
    return M.apply_schema(_raw(s, d), [
        {"name": "ORDER_ID", "type": "num", "target_type": "DOUBLE", "label": "Order"},
        {"name": "ORDER_DAY", "type": "num", "target_type": "DATE"},
        {"name": "ORDER_AT", "type": "num", "target_type": "TIMESTAMP_NTZ"},
        {"name": "TOTAL", "type": "num", "target_type": "DECIMAL(20,2)"},
        {"name": "PRIORITY", "type": "char", "target_type": "STRING", "length": 5},
    ]).withColumn("total", F.col("total").cast("double"))


QUERIES = {
    "map_types_lakehouse": _map("lakehouse"),
    "map_types_lakehouse_strict": _map("lakehouse", True),
    "map_types_warehouse": _map("warehouse"),
    "map_types_warehouse_strict": _map("warehouse", True),
    "apply_schema": _apply,
    "apply_schema_warehouse": _warehouse,
    "migration_plan": lambda s, d: M.migration_plan(view(s, d, "datasets_meta"), _cols(s, d)),
}

IS_DATE = "format IN ('DDMMYY10.', 'DATE9.', 'YYMMDD10.')"
IS_STAMP = "format IN ('DATETIME20.', 'E8601DT.')"
LAKE = f"""CASE WHEN type = 'num' THEN CASE WHEN {IS_DATE} THEN 'DATE' WHEN {IS_STAMP} THEN 'TIMESTAMP' WHEN format = 'COMMAX20.18' THEN 'DECIMAL(38,18)'
  WHEN format IN ('COMMAX20.2', 'DOLLAR12.2') THEN 'DECIMAL(20,2)' ELSE 'DOUBLE' END ELSE 'STRING' END"""
LAKE_STRICT = f"""CASE WHEN type = 'num' THEN CASE WHEN {IS_DATE} OR format = 'DATETIME20.' THEN 'DATE' WHEN {IS_STAMP} THEN 'TIMESTAMP'
  WHEN format IN ('COMMAX20.2', 'COMMAX20.18', 'DOLLAR12.2') THEN 'DECIMAL(20,2)' ELSE 'DOUBLE' END ELSE 'STRING' END"""
HOUSE = """CASE WHEN type = 'num' THEN CASE WHEN {0} THEN 'DATE' WHEN {1} THEN 'TIMESTAMP_NTZ' ELSE 'NUMBER(38,10)' END
  WHEN type = 'char' THEN 'VARCHAR(' || length || ')' ELSE 'VARCHAR(256)' END"""


def m(e):
    return with_views("columns_meta", f"SELECT dataset_name, position, name, {e} AS target_type FROM columns_meta")


ORACLE = {
    "map_types_lakehouse": m(LAKE),
    "map_types_lakehouse_strict": m(LAKE_STRICT),
    "map_types_warehouse": m(HOUSE.format(IS_DATE, IS_STAMP)),
    "map_types_warehouse_strict": m(HOUSE.format(f"{IS_DATE} OR format = 'DATETIME20.'", IS_STAMP)),
    "apply_schema": """SELECT CAST(o_orderkey AS DOUBLE) AS order_id, CAST(o_orderdate AS DATE) AS order_day, date_trunc('second', o_orderdate) AS order_at,
      o_totalprice AS total, substr(o_orderpriority, 1, 5) AS priority FROM orders""",
    "apply_schema_warehouse": """SELECT CAST(o_orderkey AS DOUBLE) AS order_id, CAST(o_orderdate AS DATE) AS order_day, date_trunc('second', o_orderdate) AS order_at,
      o_totalprice AS total, substr(o_orderpriority, 1, 3) AS priority FROM orders""",
    "migration_plan": with_views("columns_meta datasets_meta", f"""WITH t AS (SELECT dataset_name, {LAKE} AS tt FROM columns_meta)
      SELECT d.dataset_name, d.row_count, count(*) AS n_columns, count(*) FILTER (tt = 'DATE') AS n_date, count(*) FILTER (tt = 'TIMESTAMP') AS n_timestamp,
        count(*) FILTER (tt LIKE 'DECIMAL%') AS n_decimal, count(*) FILTER (tt = 'DOUBLE') AS n_double, count(*) FILTER (tt = 'STRING') AS n_string
      FROM datasets_meta d JOIN t ON d.dataset_name = t.dataset_name GROUP BY 1, 2"""),
}
