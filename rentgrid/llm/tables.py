"""Reading inputs and cutting lineage through the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.session import shuffles_removed

#: Rows per Arrow batch handed to Python (bounds a worker's memory).
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table; all reads go through Spark's own readers."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table under ``spark.checkpoint.dir``.

    The setting names the folder that the driver and all executors share.
    Only where it is unset on a local master (tests) a temporary folder is
    made; on a cluster without the setting this is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "rentgrid-llm")
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: later reads do not repeat its lineage,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*tables: DataFrame | str) -> None:
    """Remove written tables (or paths of such) that nothing will read again:
    what was made of them is itself written."""
    for table in tables:
        name = table if isinstance(table, str) else table._written_path
        jvm_session = SparkSession.getActiveSession()
        path = jvm_session.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(jvm_session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else (null stays null).

    ``lower`` equals that on ASCII text, and is much faster than the
    per-character map, which the other texts take.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


#: Rows of a join side that may be sent to every executor (ids and the like).
SENT_ROWS = 1_000_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A narrow written table as a join side: sent to every executor if it was
    counted to be small, else hashed by partition, as the other side is then."""
    return F.broadcast(df) if df.count() <= (SENT_ROWS if rows is None else rows) else df.hint("shuffle_hash")
