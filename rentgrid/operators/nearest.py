"""Comparable listings: the k nearest in size of each listing (K3).

Comparables share type and neighbourhood (NULL is a value of its own); nearest
means the smallest difference in square feet, then the smaller key.  Listings
of one (type, neighbourhood, square feet) rank one another's neighbours alike,
so only the ``k + 1`` smallest keys of each such place can be anybody's: they
are found by a ranked limit that Spark applies before its shuffle.  Places
meet places within ``reach`` square feet through bins of that width (a place
is copied to the bins beside its own), which bounds the partners of a place by
``2 * reach + 1`` whatever the number of its listings.  So the work is that of
the listings plus that of the different places, not of pairs of listings.

Listings without square feet have no comparables and are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["listing_type", "neighbourhood", "square_feet"]


def comparable_listings(df: DataFrame, key: str, k: int = 5, reach: int = 100) -> DataFrame:
    """``key, rank, comparable, square_feet_gap, price, comparable_price``."""
    rows = df.where("square_feet IS NOT NULL").select(F.col(key).alias("key"), *PLACE, "price")
    # one value for each (type, neighbourhood), so that a NULL meets a NULL
    rows = rows.withColumn("area", F.struct("listing_type", "neighbourhood")).drop("listing_type", "neighbourhood")
    few = rows.withColumn("at", F.row_number().over(Window.partitionBy("area", "square_feet").orderBy("key"))).where(F.col("at") <= k + 1)
    step = F.floor(F.col("square_feet") / max(reach, 1))
    here = few.select("area", "square_feet").distinct().select(
        "area", "square_feet", F.explode(F.array(step - 1, step, step + 1)).alias("bin"))
    there = few.select("area", F.col("square_feet").alias("size"), "key", "price", step.alias("bin"))
    gap = F.abs(F.col("size") - F.col("square_feet"))
    near = here.join(there, ["area", "bin"]).where(gap <= reach).select("area", "square_feet", "key", "price", gap.alias("gap"))
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("area", "square_feet").orderBy("gap", "key")))
    best = best.where(F.col("at") <= k + 1).groupBy("area", "square_feet").agg(
        F.array_sort(F.collect_list(F.struct("gap", "key", "price"))).alias("near"))
    mine = rows.join(best, ["area", "square_feet"])
    others = F.slice(F.filter("near", lambda n: n["key"] != F.col("key")), 1, k)
    out = mine.select("key", "price", F.posexplode(others).alias("rank", "n"))
    return out.select(F.col("key").alias(key), (F.col("rank") + 1).alias("rank"), F.col("n.key").alias("comparable"),
                      F.col("n.gap").alias("square_feet_gap"), "price", F.col("n.price").alias("comparable_price"))
