"""Read-side operators: filters, projections, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.schema import LISTING_COLUMNS


def get_listings(df: DataFrame, source: str | None = None, listing_type: str | None = None,
                 min_price: int | None = None, max_price: int | None = None, limit: int = 100,
                 key: list[str] | None = None, rows_of=None) -> DataFrame:
    """Conjunctive filters, each skipped when its argument is falsy (so 0 means
    no bound); newest ``limit`` rows by ``extracted_at``.  A NULL price drops
    out once a price bound is set.  Ties are broken by id, then price, so the
    result is deterministic.

    With ``key`` (columns that tell rows apart) the keys are ranked alone:
    each task keeps its own top ``limit`` (TakeOrderedAndProject), those
    ``limit`` keys are sent to the scan, and all other columns are computed for
    the rows that are kept.  Without it whole rows are ranked, which Spark
    plans as a full sort when projections follow.

    ``rows_of`` (a function of a frame of keys) gives the rows of ``df`` that
    have them, where that is less work than to look for them in ``df``."""
    def filtered(df: DataFrame) -> DataFrame:
        if source:
            df = df.filter(F.col("source") == source)
        if listing_type:
            df = df.filter(F.col("listing_type") == listing_type)
        if min_price:
            df = df.filter(F.col("price") >= min_price)
        if max_price:
            df = df.filter(F.col("price") <= max_price)
        return df

    df = filtered(df)
    order = [F.desc("extracted_at"), "id", "price"]
    if not key:
        return df.orderBy(*order).limit(limit)
    top = df.select(*key, *[c for c in ("extracted_at", "id", "price") if c not in key]).orderBy(*order, *key).limit(limit)
    # at most ``limit`` keys and rows
    keys = F.broadcast(top.select(*key))
    kept = filtered(rows_of(keys)) if rows_of else df.join(keys, key, "left_semi")
    return kept.repartition(1).sortWithinPartitions(*order, *key)


def with_price_bounds(df: DataFrame, min_price: int | None, max_price: int | None) -> DataFrame:
    """Capture-time price bounds (the sites applied them through URL
    parameters); on stored Parquet this filter is pushed into the scan."""
    if min_price is not None:
        df = df.filter(F.col("price") >= min_price)
    if max_price is not None:
        df = df.filter(F.col("price") <= max_price)
    return df


def has_price(df: DataFrame) -> DataFrame:
    """Truthy price: drops NULL and 0."""
    return df.filter(F.col("price").isNotNull() & (F.col("price") != 0))


def has_title(df: DataFrame) -> DataFrame:
    return df.filter(F.length("title") > 0)


def all_columns(df: DataFrame) -> DataFrame:
    """``SELECT *`` of the listing table in canonical column order."""
    return df.select(*LISTING_COLUMNS)


def first_per_source(df: DataFrame, k: int, order_cols: list[str], run_cols: list[str] | None = None) -> DataFrame:
    """First ``k`` rows per source (and run) in capture order.
    ``row_number() <= k`` lets Spark put a per-partition group limit before
    the shuffle, so a source holding most rows sends at most ``k`` rows per
    map task."""
    w = Window.partitionBy(*(run_cols or []), "source").orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def first_posts(df: DataFrame, k: int | None, order_col: str) -> DataFrame:
    """First ``k`` posts by capture order; a falsy ``k`` keeps all."""
    return df.orderBy(order_col).limit(k) if k else df


def sorted_by_price(df: DataFrame) -> DataFrame:
    return has_price(df).orderBy("price", "id")
