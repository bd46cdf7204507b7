"""Listings over time (K4): intervals on the market and the price trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.operators.graph import checkpointed


def market_spells(seen: DataFrame, key: str, day: str) -> DataFrame:
    """Intervals that a listing was on the market, from the snapshots (days)
    that hold it: ``key, spell, posted_on, last_seen_on, removed_on,
    days_listed, snapshots, relisted, days_away``.

    The snapshots are the different days of ``seen``, numbered; consecutive
    numbers are one spell.  A listing is removed on the first snapshot
    without it (NULL: still there in the newest) and re-listed with its second
    spell, ``days_away`` after the first one was last seen.  Rows are reduced
    to one per (listing, day) before anything is ordered, so a listing with a
    large share of all rows costs one row per snapshot.  Rows without a key or
    a day are left out.
    """
    rows = seen.select(F.col(key).alias("key"), F.col(day).cast("date").alias("day")).where("key IS NOT NULL AND day IS NOT NULL").distinct()
    # as many rows as there were snapshots
    runs = rows.select("day").distinct().select(
        "day", F.row_number().over(Window.orderBy("day")).alias("run"), F.lead("day").over(Window.orderBy("day")).alias("next_run"))
    rows = rows.join(runs, "day")
    order = Window.partitionBy("key").orderBy("run")
    rows = rows.withColumn("island", F.col("run") - F.row_number().over(order))
    spells = rows.groupBy("key", "island").agg(
        F.min("day").alias("posted_on"), F.max("day").alias("last_seen_on"), F.max_by("next_run", "run").alias("removed_on"),
        F.count(F.lit(1)).alias("snapshots"))
    order = Window.partitionBy("key").orderBy("posted_on")
    spell = F.row_number().over(order)
    return spells.select(
        F.col("key").alias(key), spell.alias("spell"), "posted_on", "last_seen_on", "removed_on",
        (F.datediff("last_seen_on", "posted_on") + 1).alias("days_listed"), "snapshots", (spell > 1).alias("relisted"),
        F.datediff("posted_on", F.lag("last_seen_on").over(order)).alias("days_away"))


def price_trend(observed: DataFrame, key: str, at: str, price: str = "price", area: str = "neighbourhood",
                tie: str | None = None) -> DataFrame:
    """Asking prices per area and day: ``area, day, listings, p25_price,
    median_price, p75_price, median_change``.

    On each day of the calendar (first to last day observed) a listing asks
    the price that it was last seen with, up to that day's end.  This as-of
    join is made on counts, not on listings: a listing's prices become +1 on
    the day seen and -1 on the next day it is seen again; summed up per (area,
    price, day) they give the days on which a count holds, and only those
    counts meet the calendar.  Quantiles are the elements ``n // 4``, ``n // 2``
    and ``3 * n // 4`` of the ascending prices, read from the counts.

    A listing's rows are reduced to the last of each day before they are
    ordered, so one with a large share of all rows is spread over days.
    Observations without a price (NULL or 0), a key or a time are no
    observations; an area that is NULL is a group of its own.
    """
    rows = observed.where(F.col(key).isNotNull() & F.col(at).isNotNull() & (F.coalesce(F.col(price), F.lit(0)) != 0))
    order = F.struct(at, tie) if tie else F.struct(at, price)
    daily = rows.groupBy(F.col(key).alias("key"), F.to_date(at).alias("day")).agg(
        F.max_by(F.struct(F.col(area).alias("area"), F.col(price).alias("price")), order).alias("last"))
    daily = checkpointed(daily)
    last_day = F.lit(daily.agg(F.max("day")).first()[0]).cast("date")
    until = daily.withColumn("until", F.lead("day").over(Window.partitionBy("key").orderBy("day")))
    change = F.explode(F.array(F.struct(F.col("day").alias("day"), F.lit(1).alias("by")),
                               F.struct(F.col("until").alias("day"), F.lit(-1).alias("by"))))
    steps = until.select("last.area", "last.price", change.alias("c")).where("c.day IS NOT NULL")
    steps = steps.groupBy("area", "price", F.col("c.day").alias("day")).agg(F.sum("c.by").alias("by")).where("by <> 0")
    line = Window.partitionBy("area", "price").orderBy("day")
    held = steps.select("area", "price", "day", F.sum("by").over(line).alias("many"), F.lead("day").over(line).alias("until")).where("many > 0")
    stop = F.coalesce(F.date_sub("until", 1), last_day)
    days = held.select("area", "price", "many", F.explode(F.sequence("day", stop)).alias("day"))
    ranks = Window.partitionBy("area", "day")
    upto = days.select("area", "day", "price", F.sum("many").over(ranks).alias("n"),
                       F.sum("many").over(ranks.orderBy("price").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    quantile = lambda num, den: F.min(F.when(F.col("upto") > F.floor(F.col("n") * num / den), F.col("price")))
    out = upto.groupBy("area", "day").agg(
        F.max("n").alias("listings"), quantile(1, 4).alias("p25_price"), quantile(1, 2).alias("median_price"),
        quantile(3, 4).alias("p75_price"))
    before = F.lag("median_price").over(Window.partitionBy("area").orderBy("day"))
    return out.select(F.col("area").alias(area), "day", "listings", "p25_price", "median_price", "p75_price",
                      (F.col("median_price") - before).alias("median_change"))
