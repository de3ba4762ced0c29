"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerlift", cores: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    # one machine: a local session, as in tests
    fallback = tempfile.mkdtemp(prefix="ledgerlift-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


_named: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root; nothing is created yet."""
    _named.append(f"{shared_root(spark)}/ledgerlift/{label}-{uuid.uuid4().hex[:12]}")
    return _named[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own the intermediate tables written inside the block and remove them at its end.

    Results must have been written or collected by then. Checkpoints are removed by Spark where
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    before = len(_named)
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _named[before:]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        del _named[before:]


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and drop the lineage before them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    For results that several later steps read: columns stay prunable, which a checkpoint's
    rows are not.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_table(df: DataFrame, label: str, *keys: str, name: str | None = None) -> str:
    """Write the rows to the shared folder as a table of one bucket per shuffle partition by `keys`, or add them to one; its name."""
    writer = df.write.format("parquet").bucketBy(buckets(df.sparkSession), *keys)
    if name is None:
        path = shared_dir(df.sparkSession, label)
        name = f"ledgerlift_{path.rsplit('-', 1)[1]}"
        writer.option("path", path).saveAsTable(name)
    else:
        writer.mode("append").saveAsTable(name)
    return name


def bucketed(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """`stored`, in buckets: groupings and windows that have `keys` among theirs, and joins on just these (or, after
    `join_in_buckets`, on more), read the rows where they lie, without a shuffle. Rows best arrive dealt out by the keys; else every task writes every bucket.
    """
    return df.sparkSession.table(bucket_table(df, label, *keys))


def join_in_buckets(spark: SparkSession) -> None:
    """Let sides dealt out by one of the keys of a join meet as they lie; else Spark deals both out anew by all its keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Bytes of rows that Spark hands a Python worker at once; its own limit of 64 MB is held several times over, in the JVM and the worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand Python workers a few MB of rows at once, as long texts are many MB in few rows; a larger row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def compiled_methods(spark: SparkSession) -> None:
    """Have Spark cut generated methods above 8000 bytes into small ones: the JVM never compiles longer ones."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
