"""File sources and sinks: scans, metadata sidecars, delimited and zipped text, loads, exports."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from datetime import timedelta
from fnmatch import translate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlift.functions.informats import informat
from ledgerlift.operators.catalog import row_counts
from ledgerlift.session import stored

META_SCHEMA = (
    "dataset_name string, row_count bigint, column_count int, size_bytes bigint, description string, "
    "columns array<struct<name:string,type:string,length:int,format:string,label:string>>"
)


def _glob(ext: str) -> str:
    """Hadoop glob matching the extension in any case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def _files(spark: SparkSession, base: str, ext: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(ext))
        .load(base)
    )


def relative_path(path: Column, base: str) -> Column:
    return F.regexp_replace(path, r"^(?:[A-Za-z0-9]+:/*)?/*" + re.escape(base.strip("/")) + "/", "")


def keep_path(path: Column, base: str, exclude: list[str], max_depth: int | None) -> Column:
    """Not below `max_depth` folders if one is given, and no excluded text in the path nor excluded glob on a name from `base` down."""
    rel = relative_path(path, base)
    ok = F.lit(True) if max_depth is None else (F.length(rel) - F.length(F.replace(rel, F.lit("/")))) < max_depth
    below = F.split(F.concat(F.lit(base.rstrip("/").split("/")[-1] + "/"), rel), "/")
    for pattern in exclude:
        glob = translate(pattern).replace(r"\Z", r"\z")
        named = F.exists(below, lambda part: part.rlike(f"^{glob}"))
        ok = ok & ~path.contains(pattern) & ~named
    return ok


def program_rows(files: DataFrame, base: str, exclude: list[str] = (), max_depth: int | None = None) -> DataFrame:
    """Program inventory from rows (path, modificationTime, length, content)."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    ends = F.regexp_count(text, F.lit("\r\n|\n|\r"))
    closed = (F.length(text) == 0) | text.rlike("(?:\n|\r)\\z")
    return files.where(keep_path(F.col("path"), base, list(exclude), max_depth)).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("path").alias("absolute_path"),
        relative_path(F.col("path"), base).alias("relative_path"),
        F.col("length").alias("size_bytes"),
        (ends + F.when(closed, 0).otherwise(1)).alias("line_count"),
        F.col("modificationTime").alias("last_modified"),
        F.lit("utf-8").alias("encoding"),
        text.alias("content"),
    )


def dataset_rows(files: DataFrame, base: str, exclude: list[str] = (), max_depth: int | None = None) -> DataFrame:
    """Dataset inventory from rows (path, length); contents are never read."""
    parts, name = F.split("path", "/"), F.element_at(F.split("path", "/"), -1)
    return files.where(keep_path(F.col("path"), base, list(exclude), max_depth)).select(
        name.alias("filename"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("dataset_name"),
        F.col("path").alias("absolute_path"),
        F.element_at(parts, -2).alias("inferred_library"),
        F.regexp_extract(name, r"\.([^.]*)$", 1).alias("file_type"),
        F.col("length").alias("size_bytes"),
    )


def _each(paths: list[str], build) -> DataFrame:
    out = build(paths[0])
    for p in paths[1:]:
        out = out.unionByName(build(p))
    return out


def scan_programs(spark: SparkSession, paths: list[str], exclude: list[str] = (), max_depth: int | None = None) -> DataFrame:
    return _each(paths, lambda p: program_rows(_files(spark, p, "sas"), p, exclude, max_depth))


# Extensions of dataset files.
DATASET_EXTENSIONS = ["sas7bdat", "xpt", "sas7bcat"]


def scan_dataset_files(spark: SparkSession, paths: list[str], exclude: list[str] = (), max_depth: int | None = None,
                       extensions: list[str] = DATASET_EXTENSIONS) -> DataFrame:
    return _each(
        [(p, e) for p in paths for e in extensions],
        lambda pe: dataset_rows(_files(spark, *pe).select("path", "length"), pe[0], exclude, max_depth),
    )


def log_rows(files: DataFrame, base: str, exclude: list[str] = (), max_depth: int | None = None) -> DataFrame:
    """Log inventory from rows (path, length, modificationTime); contents are never read."""
    return files.where(keep_path(F.col("path"), base, list(exclude), max_depth)).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("absolute_path"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"))


def scan_logs(spark: SparkSession, paths: list[str], exclude: list[str] = (), max_depth: int | None = None,
              extension: str = "log") -> DataFrame:
    """Log inventory; excluded folders are left out."""
    read = lambda p: _files(spark, p, extension).select("path", "length", "modificationTime")
    return _each(paths, lambda p: log_rows(read(p), p, exclude, max_depth))


# --- metadata sidecars ----------------------------------------------------------------------


def meta_rows(texts: DataFrame) -> DataFrame:
    """Dataset metadata from rows (path, value), value holding one JSON document."""
    return texts.select("path", F.from_json("value", META_SCHEMA).alias("m")).select(
        F.regexp_replace("path", r"\.meta\.json$", "").alias("data_path"), "m.*"
    )


def read_dataset_meta(spark: SparkSession, paths: list[str], extensions: list[str] = DATASET_EXTENSIONS) -> DataFrame:
    """Metadata of every data file: from its sidecar, else unknown counts and no columns."""
    sidecars = _each(
        paths,
        lambda p: spark.read.text(p, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.meta.json")
        .select(F.col("_metadata.file_path").alias("path"), "value"),
    )
    known = meta_rows(sidecars)
    found = scan_dataset_files(spark, paths, extensions=extensions)
    key = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    lone = found.select(F.col("absolute_path").alias("data_path"), F.col("dataset_name").alias("file_name"), F.col("size_bytes").alias("file_size"))
    joined = known.withColumn("k", key("data_path")).join(
        lone.withColumn("k", key("data_path")).drop("data_path"), "k", "full")
    return joined.select(
        F.col("k").alias("data_path"), F.coalesce("dataset_name", "file_name").alias("dataset_name"),
        "row_count", "column_count", F.coalesce("size_bytes", "file_size").alias("size_bytes"), "description",
        F.coalesce("columns", F.from_json(F.lit("[]"), "array<struct<name:string,type:string,length:int,format:string,label:string>>")).alias("columns"),
    )


def meta_columns(meta: DataFrame) -> DataFrame:
    return meta.select("dataset_name", F.inline("columns"))


# --- delimited and zipped text --------------------------------------------------------------


def apply_informats(df: DataFrame, layout: list[tuple[str, str]]) -> DataFrame:
    """Text columns to typed values; an unreadable field is missing."""
    return df.select(*[informat(F.col(name), spec).alias(name) for name, spec in layout])


def _western(df: DataFrame) -> DataFrame:
    """Text read as ISO-8859-1 turned into Windows-1252: only bytes 80 to 9F differ."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "replace")) for b in range(0x80, 0xA0)]
    src, dst = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return df.select(*[F.translate(c, src, dst).alias(c) for c in df.columns])


# Names of the Windows western code page.
WESTERN = ("wlatin1", "windows-1252", "cp1252")


def read_delimited(spark: SparkSession, path: str | list[str], layout: list[tuple[str, str]], sep: str = ";",
                   encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Delimited text with a layout of (column, informat); short rows give missing values."""
    schema = ", ".join(f"`{name}` string" for name, _ in layout)
    western = encoding.lower() in WESTERN
    raw = (
        spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", "true")
        .option("encoding", "ISO-8859-1" if western else encoding).option("mode", "PERMISSIVE").csv(path)
    )
    return apply_informats(_western(raw) if western else raw, layout)


def zip_members(files: DataFrame, member: str = r".*", encoding: str = "utf-8") -> DataFrame:
    """Lines of the matching text members of zip files given as rows (path, content).

    Archives are unpacked by the tasks that hold them and lines leave in batches, so one
    archive never has to fit in memory as text.
    """
    pattern = re.compile(member)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if pattern.fullmatch(name):
                            with archive.open(name) as raw:
                                text = io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline=None)
                                start = 1
                                while lines := text.readlines(1 << 20):
                                    yield pd.DataFrame({
                                        "path": path, "member": name,
                                        "line_no": range(start, start + len(lines)),
                                        "line": [line.rstrip("\n") for line in lines],
                                    })
                                    start += len(lines)

    return files.select("path", "content").mapInPandas(unpack, "path string, member string, line_no bigint, line string")


def read_zip_members(spark: SparkSession, path: str, layout: list[tuple[str, str]], member: str = r".*",
                     sep: str = ";", first_line: int = 2) -> DataFrame:
    """Typed rows of delimited members inside zip files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return parse_lines(zip_members(files, member), layout, sep, first_line)


def parse_lines(lines: DataFrame, layout: list[tuple[str, str]], sep: str = ";", first_line: int = 2) -> DataFrame:
    schema = ", ".join(f"`{name}` string" for name, _ in layout)
    fields = F.from_csv("line", F.lit(schema), {"sep": sep, "mode": "PERMISSIVE"})
    rows = lines.where(F.col("line_no") >= first_line).select(fields.alias("r")).select("r.*")
    return apply_informats(rows, layout)


# --- loads and sinks --------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


_FILE = ["file", "size", "modified"]


def _listing(spark: SparkSession, src: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(src)
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def loaded_files(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The log: file, size, modified, load_id, loaded_at and the file's good and rejected rows."""
    log = f"{table_path}_load_log"
    return spark.read.parquet(log) if _exists(spark, log) else None


def copy_into(spark: SparkSession, src: str, table_path: str, schema: str | StructType | None = None,
              on_error: str = "continue", sep: str = ",", merge_schema: bool = True) -> int:
    """Load CSV files not loaded before; returns how many files were new.

    Rows go to a folder of their own load id and the log, with each file's good and rejected
    rows, is written last. Readers see only logged loads, so a load that died half-way is
    invisible and is simply done again; if two loads run at the same time and both log a file,
    readers take the one logged first. Which files are new is a join of the listing with the
    log; no list of files goes through the driver. Without a schema it is inferred from the
    new files. Columns the table does not have are an error unless `merge_schema` is on.
    """
    log, listing = loaded_files(spark, table_path), _listing(spark, src)
    fresh = stored(listing if log is None else listing.join(log, _FILE, "left_anti"), "new-files")
    number, oldest = fresh.agg(F.count(F.lit(1)), F.min("modified")).first()
    if not number:
        return 0
    # older files need not be opened; two days allow for any time zone
    since = (oldest - timedelta(days=2)).strftime("%Y-%m-%dT%H:%M:%S")
    reader = (
        spark.read.option("header", "true").option("sep", sep).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv").option("modifiedAfter", since)
    )
    if schema is None:
        schema = reader.option("inferSchema", "true").csv(src).schema
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if log is not None and not merge_schema:
        known = set(spark.read.option("mergeSchema", "true").parquet(table_path).columns)
        if new := [f.name for f in fields if f.name not in known]:
            raise ValueError(f"columns {new} are not in {table_path}")
    rows = (
        reader.schema(StructType([*fields, StructField("_bad", StringType())])).option("columnNameOfCorruptRecord", "_bad")
        .option("mode", "PERMISSIVE" if on_error == "continue" else "FAILFAST").csv(src)
        .select("*", F.col("_metadata.file_path").alias("_file"))
    )
    load = f"load-{uuid.uuid4().hex}"
    rows.join(fresh.select(F.col("file").alias("_file")), "_file", "left_semi").write.parquet(f"{table_path}/load_id={load}")
    counts = spark.read.parquet(f"{table_path}/load_id={load}").groupBy(F.col("_file").alias("file")).agg(
        F.count(F.when(F.col("_bad").isNull(), 1)).alias("good"), F.count("_bad").alias("rejected"))
    logged = fresh.join(counts, "file", "left").fillna(0, ["good", "rejected"])
    logged.withColumns({"load_id": F.lit(load), "loaded_at": F.current_timestamp()}).write.mode("append").parquet(f"{table_path}_load_log")
    return number


def read_loaded(spark: SparkSession, table_path: str) -> DataFrame:
    """Good rows of the logged loads, each file once, columns of all loads merged."""
    log = loaded_files(spark, table_path)
    if log is None:
        raise ValueError(f"nothing has been loaded into {table_path}")
    first = log.groupBy(*_FILE).agg(F.min(F.struct("loaded_at", "load_id"))["load_id"].alias("load_id"))
    taken = first.select("load_id", F.col("file").alias("_file"))
    table = spark.read.option("mergeSchema", "true").parquet(table_path)
    return table.join(taken, ["load_id", "_file"], "left_semi").where("_bad is null").drop("load_id", "_file", "_bad")


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> DataFrame:
    """CREATE OR REPLACE TABLE AS SELECT; returns the stored table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", "true").csv(path)


def bulk_copy(spark: SparkSession, tables: dict[str, DataFrame], dst: str) -> DataFrame:
    """Copy every table of a library below `dst`; returns name and row count of each copy."""
    copies = {name: overwrite_table(df, f"{dst}/{name}") for name, df in tables.items()}
    return row_counts(copies)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return row_counts(tables)
