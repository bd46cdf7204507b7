"""Listing snapshots as JSON (A13-A16, F4, G2 input).

Sink: a batch of listings goes to ``prefix/date=YYYY-MM-DD/time=HHMMSS/`` as
JSON lines (one object per listing, all 55 fields and its position, NULLs kept,
ISO timestamps).  Writing a snapshot again replaces it.  Source: the same
folders with a fixed schema; a ``date`` filter prunes folders, and the newest
snapshot is found by listing folders.  Snapshots kept as one array a file,
``prefix/YYYY-MM-DD/HHMMSS.json``, are read by ``read_array_snapshots``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.schema import LISTING_COLUMNS, LISTING_SCHEMA

JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "ignoreNullFields": "false"}

SNAPSHOT_SCHEMA = T.StructType(LISTING_SCHEMA.fields + [T.StructField("position", T.LongType())] + [
    T.StructField("date", T.StringType()), T.StructField("time", T.StringType())])


def write_snapshot(df: DataFrame, prefix: str, at: dt.datetime) -> str:
    """Write one snapshot, in place of an earlier try; returns its folder."""
    path = f"{prefix}/date={at.strftime('%Y-%m-%d')}/time={at.strftime('%H%M%S')}"
    rows = df.select(*LISTING_COLUMNS, F.monotonically_increasing_id().alias("position"))
    rows.write.mode("overwrite").options(**JSON_OPTIONS).json(path)
    return path


def read_snapshots(spark: SparkSession, prefix: str, date: str | None = None) -> DataFrame:
    df = spark.read.schema(SNAPSHOT_SCHEMA).options(**JSON_OPTIONS).json(prefix)
    return df.filter(F.col("date") == date) if date else df


def read_array_snapshots(spark: SparkSession, prefix: str) -> DataFrame:
    """Snapshots of one JSON array a file; date and time come from the path,
    the position is the place in the array."""
    path = F.col("_metadata.file_path")
    df = (spark.read.schema(LISTING_SCHEMA).option("multiLine", "true")
               .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]").json(f"{prefix}/*/*.json"))
    return df.select(*LISTING_COLUMNS, F.monotonically_increasing_id().alias("position"),
                     F.regexp_extract(path, r"/([0-9]{4}-[0-9]{2}-[0-9]{2})/[^/]*$", 1).alias("date"),
                     F.regexp_extract(path, r"/([0-9]{6})[.]json$", 1).alias("time"))


def _newest(spark: SparkSession, path: str, name: str) -> str | None:
    """The greatest ``name=value`` folder under a path, by the file system."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return max((x[len(name) + 1:] for x in found if x.startswith(f"{name}=")), default=None)


def read_latest(spark: SparkSession, prefix: str) -> DataFrame:
    """The newest snapshot: only its folder is read."""
    date = _newest(spark, prefix, "date")
    time = date and _newest(spark, f"{prefix}/date={date}", "time")
    df = read_snapshots(spark, prefix)
    return df.filter((F.col("date") == date) & (F.col("time") == time)) if time else df.limit(0)


def latest(df: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of a frame."""
    newest = df.agg(F.max(F.struct("date", "time")).alias("_m")).select("_m.date", "_m.time")
    return df.join(newest, ["date", "time"], "left_semi")


def to_json_lines(df: DataFrame, keep: tuple | list = ()) -> DataFrame:
    """One JSON text per listing (enum text, ISO timestamps, NULLs kept)."""
    return df.select(*keep, F.to_json(F.struct(*LISTING_COLUMNS), JSON_OPTIONS).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    """Write the current result as JSON lines."""
    df.select(*LISTING_COLUMNS).write.mode("overwrite").options(**JSON_OPTIONS).json(path)
