"""Small helpers shared by the operators of this subpackage.

Every operator starts by naming the columns it reads, so extra columns, also ones
whose names clash with a result column, never reach it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import checkpoint_dir

#: White space of every contract: space, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text with null read as empty; nothing else."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ship(spark) -> None:
    """Sends this package's source to the executors, once per Spark context, so that
    tasks can import it wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_basketry_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="basketry-ship-"), "basketry-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._basketry_shipped = True


def over_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def words(text: str) -> list[bytes]:
    """Maximal runs of other characters than ``SPACE`` (bytes.split knows just these)."""
    return text.encode("utf-8", "surrogatepass").split()


def lowered_words(text: str) -> list[bytes]:
    """``words`` with A-Z in lower case; bytes.lower leaves every other character."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def scratch(spark, what: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder (file:, hdfs:, s3:, ...), for tasks that write
    files that are no tables."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: the lineage
    is cut, several readers share one computation, and a lost executor costs only
    the tasks it ran."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``, so that Python objects exist for
    a few texts at a time whatever size the session gives its Arrow batches."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
