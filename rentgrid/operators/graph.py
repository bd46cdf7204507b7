"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.session import shuffles_removed


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all
    executors share (a temporary one only where that is unset on a local
    master)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rentgrid-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint()


class Steps:
    """Intermediate tables of one job, as compressed Parquet in the shared
    folder; each is dropped once no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/step-{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[0])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: every node of an edge with the smallest node that it
    reaches.

    Each round hooks every node to the smallest label around it and then
    follows that label's own label, so long chains shorten by halves.  Both
    steps are joins on the node; the only value that reaches the driver is
    whether a label changed.
    """
    steps = Steps(edges.sparkSession)
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = steps.keep(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    kept = steps.keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    labels = kept
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        hooked = labels.join(around, "node").select("node", "root", F.least("root", "near").alias("low"))
        # a smaller label found by any node lowers the whole tree under the old one
        lower = hooked.where("low < root").groupBy("root").agg(F.min("low").alias("lowered"))
        hooked = hooked.join(lower, "root", "left").select("node", "root", F.least("low", F.coalesce("lowered", "low")).alias("low"))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = steps.keep(hooked.join(jump, "low", "left").select(
            "node", F.coalesce("next", "low").alias("new"), F.col("root").alias("old")))
        steps.drop(kept)
        kept, labels = after, after.select("node", F.col("new").alias("root"))
        if after.where("new < old").isEmpty():
            steps.drop(both)
            return labels
