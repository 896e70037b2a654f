"""Session helpers: a tuned local session for tests/bench, the checkpoint folder,
and a broadcast hint that is only given behind a row-count check."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "basketry") -> SparkSession:
    """Session used by tests and the bench. On a cluster, build your own session;
    the library only reads settings from it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("BASKETRY_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or one already
    set on the SparkContext). Only a local-mode session without one gets a fresh
    temporary folder, as in tests."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if re.fullmatch(r"local(\[.*\])?", sc.master):    # local-cluster[...] is a cluster
        folder = tempfile.mkdtemp(prefix="basketry-ckpt-",
                                  dir=os.environ.get("BASKETRY_SCRATCH"))
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) "
        "so that lineage can be cut reliably on the cluster")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage ends
    there and survives executor loss, and every reader scans only the columns and rows
    it asks for."""
    spark = df.sparkSession
    path = scratch_path(spark, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH = re.compile(r".+-[0-9a-f]{32}")


def expire_scratch(spark: SparkSession, older_than_hours: float) -> int:
    """Deletes the intermediate tables and files of this library in the shared folder that
    were last written longer ago than given; returns how many. Results that have not been
    written yet may still read their tables, so take more hours than any job runs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit = (time.time() - 3600 * older_than_hours) * 1000
    old = [s.getPath() for s in fs.listStatus(path)
           if s.getModificationTime() < limit and _SCRATCH.fullmatch(s.getPath().getName())]
    for p in old:
        fs.delete(p, True)
    return len(old)


SPREAD_ROWS = 500_000


def spread(df: DataFrame, *cols: str, rows: int = 0) -> DataFrame:
    """Deals rows by ``cols`` over as many partitions as the session has shuffle partitions,
    or more, so that one has about ``SPREAD_ROWS`` of the given number of rows.
    For rows that each expand to many in the next step, or are sorted and held there: adaptive
    coalescing would fold them into few tasks by their own size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // SPREAD_ROWS)), *cols)


MAX_BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame):
    """Bytes of a row as a column: lengths of text, 8 for any other value."""
    total = F.lit(8)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        total = total + (F.coalesce(F.octet_length(c), F.lit(0)) + 16
                         if f.dataType.typeName() in ("string", "binary") else F.lit(8))
    return total


def bounded_broadcast(df: DataFrame, max_rows: int,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the side is proven small, in rows and in bytes.

    Looks at ``max_rows + 1`` rows at most; if the side is larger, the plain DataFrame
    is returned and AQE / the optimizer pick a shuffle join with their own size checks."""
    n, size = (df.limit(max_rows + 1).select(_row_bytes(df).cast("long").alias("b"))
               .agg(F.count("b"), F.coalesce(F.sum("b"), F.lit(0))).first())
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df
