"""Shared relations for the registered queries (Spark and oracle SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rentgrid.operators.enrich import enrich, enrich_sql
from rentgrid.sources.captures import decode, decode_sql
from rentgrid.sources.fixture import AS_OF, listing_raw, listing_raw_sql


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded listings (derived columns not yet filled)."""
    return decode(listing_raw(spark, sf_dir), AS_OF)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded and enriched listings: the 55-column listing table."""
    return enrich(listings(spark, sf_dir))


def with_ctes(body: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs it reads."""
    ctes = {
        "listing_raw": listing_raw_sql(),
        "listings": decode_sql("listing_raw", AS_OF),
        "enriched": enrich_sql("listings"),
    }
    order = ["listing_raw", "listings", "enriched"]
    need = set()
    for n in names:
        need.update(order[: order.index(n) + 1])
    parts = [f"{n} AS (\n{ctes[n]}\n)" for n in order if n in need]
    body = body.lstrip()
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        # the query brings its own CTEs: chain them after the shared ones
        return ("WITH " + ",\n".join(parts) + ",\n" + body[5:]) if parts else body
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
