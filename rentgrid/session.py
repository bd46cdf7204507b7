"""Session, table and checkpoint helpers."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_spark(master: str | None = None, app: str = "rentgrid", shuffle_partitions: int | None = None,
              **conf) -> SparkSession:
    """A session configured for this library (AQE on, UTC, Arrow on).

    On a cluster the master and resources come from spark-submit; the local
    defaults only apply when nothing is set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def computed(df: DataFrame, *columns: str) -> DataFrame:
    """The frame with filters on ``columns`` kept above their computation.

    Spark moves a filter below the projections that make its columns and so
    writes out their whole expressions, once for every use in it.  A one-row
    generator is where it stops: each value is computed once a row.
    """
    made = df.withColumn("_computed", F.explode(F.array(F.struct(*columns))))
    return made.select(*[F.col(f"_computed.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def rebalance(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Spread rows over the cluster before a CPU-heavy narrow pass, as a scan
    of few, large row groups gives few tasks.

    Rows go round-robin, or by ``keys``, to ``partitions`` tasks (default: the
    shuffle partitions of the session).  The number is given, as AQE would
    else merge tasks by their bytes, which are few before such a pass.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, the shuffle files of a job go when it ends.

    Else they stay until the driver's garbage collector happens to find them,
    long after the table that was written from them.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if old is None else spark.conf.set(setting, old)
