"""Price statistics.

Median and quartiles follow the source's definition on the ascending list
of truthy prices: element ``n // 2`` (upper median, no interpolation),
``n // 4`` and ``3 * n // 4`` (0-based).  Neither ``percentile`` (which
interpolates) nor ``percentile_approx`` gives that, so the exact value is
found from a histogram: ``groupBy(group, price).count()`` (partial
aggregation, so a hot group costs one row per distinct price per task),
then a running count per group over the distinct prices, and the smallest
price whose running count passes the position.  Work after the shuffle is
proportional to the number of distinct prices, not of rows; the other
statistics come from the same histogram.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Prices per range of the first look at quantile positions.
PRICE_RANGE = 1024


def price_summary(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """count(*), priced count, min, max, mean (2 decimals), median, p25, p75.

    Everything comes from one ``(group, price)`` histogram, so the listings
    are scanned once and only one row per distinct price and group is
    shuffled; NULL and 0 prices stay in the histogram for ``count(*)``.

    Positions are found in two steps: first over ranges of prices, then over
    the prices of the few ranges that hold a position.  So no window sees all
    distinct prices, with or without groups.
    """
    group_cols = group_cols or []
    return summary_of(df.groupBy(*group_cols, "price").agg(F.count(F.lit(1)).alias("_c")), group_cols)


def summary_of(hist: DataFrame, group_cols: list[str]) -> DataFrame:
    """The summary of a histogram: ``_c`` listings per group and price."""
    truthy = F.col("price").isNotNull() & (F.col("price") != 0)
    tp, pc = F.when(truthy, F.col("price")), F.when(truthy, F.col("_c"))
    base = hist.groupBy(*group_cols).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("listings"),
        F.coalesce(F.sum(pc), F.lit(0)).alias("priced"),
        F.min(tp).alias("min_price"),
        F.max(tp).alias("max_price"),
        F.round(F.sum(tp.cast("long") * F.col("_c")) / F.sum(pc), 2).alias("avg_price"))
    # a filter on the count, not the price: it stays above the histogram, which all parts then share
    prices = hist.withColumn("_c", pc).where("_c > 0").withColumn("_range", F.floor(F.col("price") / PRICE_RANGE))
    ranges = prices.groupBy(*group_cols, "_range").agg(F.sum("_c").alias("_in"))
    upto = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.select(*group_cols, "_range", "_in", F.sum("_in").over(upto).alias("_upto"),
                           F.sum("_in").over(Window.partitionBy(*group_cols)).alias("_n"))
    shares = {"median_price": (1, 2), "p25_price": (1, 4), "p75_price": (3, 4)}
    place = {name: F.floor(F.col("_n") * num / den) for name, (num, den) in shares.items()}
    holds = [(F.col("_upto") > p) & (F.col("_upto") - F.col("_in") <= p) for p in place.values()]
    wanted = ranges.where(holds[0] | holds[1] | holds[2])
    same = lambda x, y, cols: reduce(and_, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in cols])
    near = prices.alias("p").join(wanted.alias("w"), same("p", "w", [*group_cols, "_range"])).select(
        "p.*", "w._n", (F.col("w._upto") - F.col("w._in")).alias("_before"))
    inside = Window.partitionBy(*group_cols, "_range").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_cum", F.col("_before") + F.sum("_c").over(inside))
    found = near.groupBy(*group_cols).agg(*[
        F.min(F.when(F.col("_cum") > p, F.col("price"))).alias(name) for name, p in place.items()])
    out = base.alias("b").join(found.alias("f"), same("b", "f", group_cols) if group_cols else F.lit(True), "left")
    return out.select("b.*", *[f"f.{name}" for name in shares])


def count_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("listings"))


def price_coverage(df: DataFrame) -> DataFrame:
    """Priced / total listings."""
    priced_col = F.when(F.col("price") != 0, F.col("price"))
    return df.agg(F.count(priced_col).alias("priced"), F.count(F.lit(1)).alias("listings"),
                  F.round(F.count(priced_col) / F.count(F.lit(1)), 4).alias("coverage"))
