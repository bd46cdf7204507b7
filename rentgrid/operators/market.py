"""Market views the source only planned (K1-K7), built without pair
generation: every operator groups or windows over bounded keys.

* duplicate groups: listings that share a normalised key (title words,
  price, neighbourhood) across sources -- an exact key instead of pairwise
  fuzzy matching, so a large group costs one aggregate, not n^2 pairs;
* canonical listing per duplicate group: per column the first non-NULL
  value by source rank (``min_by`` over the rank of non-NULL values);
* comparables: price level of the listing's (type, neighbourhood, size
  band) group, joined back on the group key (the group table is small;
  AQE broadcasts it when its measured size allows, else sort-merge);
* price changes: observations whose price differs from the previous one of
  the same listing.  The ``lag`` runs per (listing, day) and the carry-over
  from the previous day comes from a per-day ``max_by``, so a listing with
  a huge share of all observations is spread over many tasks;
* rent percentile: share of priced listings in the same neighbourhood that
  are cheaper, from a (neighbourhood, price) histogram -- never a sort of
  all rows of one neighbourhood;
* report: an aggregate written as Parquet or CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SOURCE_RANK = {"craigslist": 1, "kijiji": 2, "facebook": 3}


def _rank(col: str = "source") -> F.Column:
    expr = None
    for name, r in SOURCE_RANK.items():
        expr = F.when(F.col(col) == name, r) if expr is None else expr.when(F.col(col) == name, r)
    return expr.otherwise(len(SOURCE_RANK) + 1)


def duplicate_key(df: DataFrame) -> DataFrame:
    """Adds ``dup_key``: lower-cased title words (punctuation dropped),
    price and neighbourhood."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^a-z0-9]+", " "))
    return df.withColumn("dup_key", F.concat_ws("|", words, F.col("price").cast("string"),
                                                 F.coalesce("neighbourhood", F.lit(""))))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Keys seen in more than one source, with listing and source counts."""
    keyed = duplicate_key(df.filter(F.col("price").isNotNull() & (F.length("title") > 0)))
    return (keyed.groupBy("dup_key")
                 .agg(F.count(F.lit(1)).alias("listings"), F.countDistinct("source").alias("sources"),
                      F.min("id").alias("first_id"))
                 .filter(F.col("sources") > 1))


def canonical_listings(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per duplicate key: per column the non-NULL value of the best
    ranked source (ties: smallest id)."""
    keyed = duplicate_key(df).withColumn("_rank", _rank())
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col("_rank"), F.col("id")))).alias(c)
            for c in columns]
    return keyed.groupBy("dup_key").agg(*aggs)


def comparables(df: DataFrame, band: int = 100) -> DataFrame:
    """Each priced listing with the size and price level of its group."""
    priced = df.filter(F.col("price").isNotNull() & (F.col("price") != 0)) \
               .withColumn("size_band", F.floor(F.col("square_feet") / band).cast("int"))
    key = ["listing_type", "neighbourhood", "size_band"]
    groups = priced.groupBy(*key).agg(F.count(F.lit(1)).alias("group_listings"),
                                      F.round(F.avg("price"), 2).alias("group_avg_price"))
    return _join_null_safe(priced, groups, key).select(
        "id", "listing_key", *key, "price", "group_listings", "group_avg_price",
        F.round(F.col("price") - F.col("group_avg_price"), 2).alias("vs_group"))


def _join_null_safe(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join where a NULL key matches the NULL group (``<=>``); Spark
    still plans it as an equi-join (hash or sort-merge), not a nested loop."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in key],
                     *[c for c in right.columns if c not in key])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in key]
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in key])


def price_changes(obs: DataFrame, key: str = "listing_id", ts: str = "observed_at", value: str = "price",
                  tie: str | None = None) -> DataFrame:
    """Observations whose ``value`` differs from the previous observation of
    the same ``key`` (the first observation counts as a change)."""
    order = [ts] + ([tie] if tie else [])
    day = F.to_date(ts)
    o = obs.withColumn("_day", day)
    w_in = Window.partitionBy(key, "_day").orderBy(*order)
    o = o.withColumn("_prev_in_day", F.lag(value).over(w_in)).withColumn("_first", F.row_number().over(w_in) == 1)
    last_of_day = o.groupBy(key, "_day").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    w_days = Window.partitionBy(key).orderBy("_day")
    carry = last_of_day.select(key, "_day", F.lag("_last").over(w_days).alias("_prev_day"))
    joined = o.join(carry, [key, "_day"], "left")
    prev = F.when(F.col("_first"), F.col("_prev_day")).otherwise(F.col("_prev_in_day"))
    return (joined.withColumn("previous", prev)
                  .filter(F.col("previous").isNull() | (F.col("previous") != F.col(value)))
                  .drop("_day", "_prev_in_day", "_first", "_prev_day"))


def rent_percentile(df: DataFrame, group: str = "neighbourhood") -> DataFrame:
    """For each priced listing: share (0..1) of priced listings in its group
    that are strictly cheaper."""
    priced = df.filter(F.col("price").isNotNull() & (F.col("price") != 0))
    hist = priced.groupBy(group, "price").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(group)
    below = hist.select(group, "price", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_below"),
                        F.sum("_c").over(wall).alias("_n"))
    return (_join_null_safe(priced, below, [group, "price"])
                  .select("id", "listing_key", group, "price",
                          F.round(F.col("_below") / F.col("_n"), 4).alias("cheaper_share")))


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write an aggregated report (Parquet or CSV with header)."""
    w = df.write.mode("overwrite")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path))
