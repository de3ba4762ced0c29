"""Sources, sinks and streaming over files that Spark writes from the tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ledgerlift.functions.informats import put_commax, put_ddmmyy
from ledgerlift.plans.views import view, with_views
from ledgerlift.session import shared_dir
from ledgerlift.sources import files as X
from ledgerlift.sources import transport as P
from ledgerlift.sources import workbooks as W
from ledgerlift.streaming.ingest import ingest, stream_then_reconcile

c = F.col
ORDERS_DDL = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderday date"
LAYOUT = [("id", "BEST12."), ("day", "DDMMYY10."), ("total", "COMMAX13."), ("status", "$CHAR1."), ("note", "$CHAR3.")]


def _orders(s, d):
    return view(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", c("o_orderdate").cast("date").alias("o_orderday"))


def _texts(s, d):
    """Orders as text fields, some of them unreadable."""
    k = c("o_orderkey")
    return view(s, d, "orders").select(
        k.cast("string").alias("id"),
        F.when(k % 11 == 0, F.lit("31/02/1999")).otherwise(put_ddmmyy(c("o_orderdate"))).alias("day"),
        F.when(k % 13 == 0, F.lit("n/a")).otherwise(put_commax(c("o_totalprice").cast("decimal(18,2)"))).alias("total"),
        c("o_orderstatus").alias("status"), c("o_orderpriority").alias("note"))


def _delimited(s, d):
    path = shared_dir(s, "delimited")
    _texts(s, d).write.option("sep", ";").option("header", "true").csv(path)
    return X.read_delimited(s, path, LAYOUT)


def _zip_rows(s, d):
    """Archives built by the tasks: one per batch, a header line and the delimited orders in each."""

    def pack(batches):
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("data.txt", "id;day;total;status;note\n" + batch.to_csv(sep=";", index=False, header=False, lineterminator="\n"))
                z.writestr("readme.md", "not data")
            yield pd.DataFrame({"path": [f"batch-{batch['id'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    return _texts(s, d).mapInPandas(pack, "path string, content binary")


def _zipped(s, d):
    return X.parse_lines(X.zip_members(_zip_rows(s, d), r".*\.txt"), LAYOUT)


BOOK = [("id", "BEST12."), ("day", "DDMMYY10."), ("serial", "DATE9."), ("total", "COMMAX13."), ("price", "BEST12."), ("status", "$CHAR1."), ("note", "$CHAR3.")]


def _books(s, d):
    """Orders as workbooks of 500 rows: texts beside numbers, and days counted from the spreadsheet's day zero."""
    texts = _texts(s, d).withColumn("id", c("id").cast("double"))
    orders = view(s, d, "orders").select(
        c("o_orderkey").cast("double").alias("id"), c("o_totalprice").alias("price"),
        F.date_diff(c("o_orderdate").cast("date"), F.lit(W.DAY_ZERO[False]).cast("date")).alias("serial"))
    rows = texts.join(orders, "id").select(*[name for name, _ in BOOK])
    # writing and parsing sheets is far dearer than the rows are large: deal them out whatever their bytes
    dealt = rows.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "id")
    return W.workbooks(dealt, "orders", "data", 500)


def _workbooks(s, d):
    return W.sheet_table(W.sheet_rows(_books(s, d), "data"), BOOK)


def _transport(s, d):
    """Orders as transport files: days and seconds by their formats, missing totals, texts cut to their widths."""
    k = c("o_orderkey")
    return view(s, d, "orders").select(
        k.cast("double").alias("id"), c("o_orderdate").cast("date").alias("day"), c("o_orderdate").alias("at"),
        F.when(k % 13 != 0, c("o_totalprice")).alias("total"), (-c("o_totalprice") / 3e9).alias("tiny"),
        c("o_orderstatus").alias("status"), c("o_orderpriority").alias("prio"))


def _transport_rows(s, d):
    rows = _transport(s, d)
    columns = [{"name": n, "type": "char" if t == "string" else "num", "format": {"day": "DATE9.", "at": "DATETIME20."}.get(n)} for n, t in rows.dtypes]
    return P.member_table(P.member_rows(P.transport_of(rows, "ORDERS", widths={"status": 1, "prio": 3})), columns)


def _transport_meta(s, d):
    """Columns of the data sets in the files, and the rows of all files together."""
    meta = P.member_meta(P.transport_of(_transport(s, d), "ORDERS", widths={"status": 1, "prio": 3}))
    columns = meta.select("dataset_name", "row_count", F.inline("columns"))
    return columns.groupBy("dataset_name", "position", "name", "type", "length", "format").agg(F.sum("row_count").alias("row_count"))


def _program_files(s, d):
    """The corpus as file rows in three folders, one of them excluded and one too deep."""
    k = c("program_id")
    folder = F.when(k % 10 == 0, "backup/").when(k % 10 == 1, "a/b/c/").otherwise(F.lit("etl/"))
    return view(s, d, "programs").select(
        F.concat(F.lit("file:/code/"), folder, "filename").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
        F.octet_length("content").cast("bigint").alias("length"), F.encode("content", "UTF-8").alias("content"))


def _scan(s, d):
    return X.program_rows(_program_files(s, d), "/code", ["backup", "old_*"], max_depth=3).select(
        "filename", "absolute_path", "relative_path", "size_bytes", "line_count", "encoding")


def _data_files(s, d):
    """A file for every described dataset, in the folder of its library; some lie in a backup folder or too deep."""
    n = F.regexp_extract("dataset_name", r"(\d+)$", 1).cast("bigint")
    library = F.when(n % 5 == 0, "raw").when(n % 7 == 0, "raw/backup").when(n % 11 == 0, "a/b/c/d").otherwise("dw")
    kind = F.when(n % 3 == 0, ".xpt").otherwise(".sas7bdat")
    return view(s, d, "datasets_meta").select(
        F.concat(F.lit("file:/lib/"), library, F.lit("/"), "dataset_name", kind).alias("path"), (n * 10).alias("length"))


def _log_files(s, d):
    """A log for every program, where the program lies."""
    return _program_files(s, d).select(
        F.regexp_replace("path", r"\.sas$", ".log").alias("path"), (F.col("length") * 2).alias("length"), "modificationTime")


def _meta(s, d):
    cols = view(s, d, "columns_meta").select("dataset_name", F.struct("position", "name", "type", "length", "format", "label").alias("c"))
    grouped = cols.groupBy("dataset_name").agg(F.array_sort(F.collect_list("c")).alias("columns"))
    docs = grouped.join(view(s, d, "datasets_meta"), "dataset_name").select(
        F.concat(F.lit("/data/"), "dataset_name", F.lit(".sas7bdat.meta.json")).alias("path"),
        F.to_json(F.struct("dataset_name", "row_count", "column_count", "columns")).alias("value"))
    return X.meta_columns(X.meta_rows(docs))


def _copy_into(s, d):
    """Two loads of a folder that gains files in between; the second must not repeat the first."""
    src, table = shared_dir(s, "copy-src"), shared_dir(s, "copy-table")
    orders = _orders(s, d)
    orders.where("o_custkey % 2 = 0").repartition(3, "o_custkey").write.option("header", "true").csv(f"{src}/first")
    X.copy_into(s, src, table, ORDERS_DDL)
    X.copy_into(s, src, table, ORDERS_DDL)
    orders.where("o_custkey % 2 = 1").repartition(3, "o_custkey").write.option("header", "true").csv(f"{src}/second")
    X.copy_into(s, src, table, ORDERS_DDL)
    return X.read_loaded(s, table)


def _export(s, d):
    path = shared_dir(s, "export")
    X.export_csv(_orders(s, d), path)
    return s.read.schema(ORDERS_DDL).option("header", "true").option("sep", ";").csv(path)


def _bulk(s, d):
    names = ["customer", "orders", "lineitem", "nation"]
    return X.bulk_copy(s, {n: view(s, d, n) for n in names}, shared_dir(s, "library"))


def _two_drops(s, d):
    """A folder that has received its first files and been ingested, and then receives the rest."""
    root = shared_dir(s, "stream")
    src, table, check = f"{root}/in", f"{root}/table", f"{root}/checkpoint"
    orders = _orders(s, d).repartition(4, "o_custkey")
    for n, part in enumerate(("o_custkey % 3 <> 0", "o_custkey % 3 = 0")):
        if n:
            ingest(s, src, table, ORDERS_DDL, check)
        orders.where(part).write.option("header", "true").mode("append").csv(src)
    return orders, src, table, check


def _ingest(s, d):
    _, src, table, check = _two_drops(s, d)
    return ingest(s, src, table, ORDERS_DDL, check)


def _stream_reconcile(s, d):
    orders, src, table, check = _two_drops(s, d)
    return stream_then_reconcile(s, src, table, ORDERS_DDL, check, orders, "orders")


QUERIES = {
    "scan_programs": _scan,
    "scan_datasets": lambda s, d: X.dataset_rows(_data_files(s, d), "/lib", ["backup"], max_depth=4),
    "scan_logs": lambda s, d: X.log_rows(_log_files(s, d), "/code", ["backup", "old_*"], max_depth=3).drop("last_modified"),
    "read_dataset_meta": _meta,
    "read_delimited": _delimited,
    "read_zip_member": _zipped,
    "read_workbooks": _workbooks,
    "read_transport": _transport_rows,
    "read_transport_meta": _transport_meta,
    "copy_into": _copy_into,
    "overwrite_table": lambda s, d: X.overwrite_table(_orders(s, d), shared_dir(s, "table"), ["o_orderstatus"]),
    "export_csv": _export,
    "bulk_copy_library": _bulk,
    "incremental_ingest": _ingest,
    "stream_then_reconcile": _stream_reconcile,
}

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderday FROM orders"
TYPED = """SELECT CAST(o_orderkey AS DOUBLE) AS id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS total, o_orderstatus AS status, rtrim(substr(o_orderpriority, 1, 3)) AS note FROM orders"""

ORACLE = {
    "scan_programs": with_views("programs", """SELECT filename, 'file:/code/' || rel AS absolute_path, rel AS relative_path, size_bytes, line_count, 'utf-8' AS encoding
      FROM (SELECT filename, 'etl/' || filename AS rel, strlen(content) AS size_bytes,
        length(content) - length(replace(content, chr(10), '')) AS line_count FROM programs WHERE program_id % 10 > 1)"""),
    "scan_datasets": with_views("datasets_meta", """WITH f AS (SELECT dataset_name, CAST(regexp_extract(dataset_name, '([0-9]+)$', 1) AS BIGINT) AS n FROM datasets_meta),
      g AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'raw' WHEN n % 7 = 0 THEN 'raw/backup' WHEN n % 11 = 0 THEN 'a/b/c/d' ELSE 'dw' END AS lib,
        CASE WHEN n % 3 = 0 THEN 'xpt' ELSE 'sas7bdat' END AS file_type FROM f)
      SELECT dataset_name || '.' || file_type AS filename, dataset_name, 'file:/lib/' || lib || '/' || dataset_name || '.' || file_type AS absolute_path,
        lib AS inferred_library, file_type, n * 10 AS size_bytes FROM g WHERE lib IN ('raw', 'dw')"""),
    "scan_logs": with_views("programs", """SELECT replace(filename, '.sas', '.log') AS filename, 'file:/code/etl/' || replace(filename, '.sas', '.log') AS absolute_path,
      2 * strlen(content) AS size_bytes FROM programs WHERE program_id % 10 > 1"""),
    "read_dataset_meta": with_views("columns_meta", "SELECT dataset_name, name, type, length, format, label FROM columns_meta"),
    "read_delimited": TYPED,
    "read_zip_member": TYPED,
    "read_workbooks": """SELECT CAST(o_orderkey AS DOUBLE) AS id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
      CAST(o_orderdate AS DATE) AS serial, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS total, o_totalprice AS price,
      o_orderstatus AS status, rtrim(substr(o_orderpriority, 1, 3)) AS note FROM orders""",
    "read_transport": """SELECT CAST(o_orderkey AS DOUBLE) AS id, CAST(o_orderdate AS DATE) AS day, o_orderdate AS at,
      CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS total, -o_totalprice / 3e9 AS tiny, o_orderstatus AS status,
      rtrim(substr(o_orderpriority, 1, 3)) AS prio FROM orders""",
    "read_transport_meta": """SELECT 'ORDERS' AS dataset_name, CAST(position AS INTEGER) AS position, name, type, CAST(length AS INTEGER) AS length, format, k AS row_count
      FROM (VALUES (0, 'ID', 'num', 8, ''), (1, 'DAY', 'num', 8, 'DATE9.'), (2, 'AT', 'num', 8, 'DATETIME20.'), (3, 'TOTAL', 'num', 8, ''),
        (4, 'TINY', 'num', 8, ''), (5, 'STATUS', 'char', 1, ''), (6, 'PRIO', 'char', 3, '')) t(position, name, type, length, format),
      (SELECT count(*) AS k FROM orders)""",
    "copy_into": ORDERS,
    "overwrite_table": ORDERS,
    "export_csv": ORDERS,
    "bulk_copy_library": " UNION ALL ".join(f"SELECT '{t}' AS dataset_name, count(*) AS row_count FROM {t}" for t in ("customer", "orders", "lineitem", "nation")),
    "incremental_ingest": ORDERS,
    "stream_then_reconcile": """SELECT 'orders' AS dataset, 'row_count' AS "check", '' AS "column", CAST(count(*) AS DOUBLE) AS expected,
      CAST(count(*) AS DOUBLE) AS actual, 'PASS' AS status FROM orders""",
}
