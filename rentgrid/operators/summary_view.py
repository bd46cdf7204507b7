"""Price statistics kept up to date (D1-D7): a stored histogram that each batch
changes, so that a daily batch does not rescan the listings.

``root/v=N`` holds the histogram after batch N: the number of listings of each
group and price.  A batch gives the rows of the listings that it touched as
they were and as they are; their difference is added to the newest version
before it.  Histograms merge, so a batch costs its touched rows plus one row per
group and distinct price.  A version is written once to a folder of its own and
counts when it is complete; applying a batch again rewrites only that folder,
from the version before.  All statistics come from the histogram, exactly as
``stats.price_summary`` finds them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.operators import stats


class PriceView:
    """The maintained view of listings by ``groups`` (columns of the listings)."""

    def __init__(self, spark: SparkSession, root: str, groups: list[str] | None = None):
        self.spark, self.root, self.groups = spark, root.rstrip("/"), groups or []

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v=*/_SUCCESS")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(re.search(r"/v=(\d+)/", f.getPath().toString())[1]) for f in files)

    def _version(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={n}")

    def histogram(self) -> DataFrame:
        """``groups, price, listings`` of the newest version."""
        return self._version(self.versions()[-1])

    def apply(self, batch: int, before: DataFrame | None, after: DataFrame, keep: int = 3) -> None:
        """Change the view by one batch: the touched listings before it (those
        that were there) and after it.  Versions older than ``keep`` go."""
        known = [v for v in self.versions() if v < batch]
        key = [*self.groups, "price"]
        counted = lambda df, sign: df.groupBy(*key).agg((F.count(F.lit(1)) * sign).alias("listings"))
        parts = counted(after, 1)
        if before is not None:
            parts = parts.unionByName(counted(before, -1))
        if known:
            parts = parts.unionByName(self._version(known[-1]))
        merged = parts.groupBy(*key).agg(F.sum("listings").alias("listings")).where("listings <> 0")
        merged.write.mode("overwrite").parquet(f"{self.root}/v={batch}")
        for old in known[:-keep]:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v={old}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def summary(self, group_cols: list[str] | None = None) -> DataFrame:
        """``stats.price_summary`` of all listings, by some of the view's groups."""
        group_cols = self.groups if group_cols is None else group_cols
        hist = self.histogram().groupBy(*group_cols, "price").agg(F.sum("listings").alias("_c"))
        return stats.summary_of(hist, group_cols)


def touched(state: DataFrame | None, batch: DataFrame, key: str = "id") -> DataFrame | None:
    """The stored rows whose key is in the batch (a missing key is a key)."""
    if state is None:
        return None
    keys = batch.select(F.col(key).alias("_touched")).distinct()
    return state.join(keys, F.col(key).eqNullSafe(F.col("_touched")), "left_semi")
