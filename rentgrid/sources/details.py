"""Detail pages joined to search cards (C3, with A5-A7 fields).

A card carries what a search result shows: a snippet, perhaps an image.  The
detail page of its url, where one was read, adds the full description, images,
coordinates, attribute flags and size.  ``attach_details`` keeps every card and
every card value that the page has no value for.  Pages of the first site add
their images to the card's and have the type read again from title and full
description; pages of the second replace the images and leave the type.

When a url was captured several times, the newest detail capture is used
(``max_by`` per url, combined map-side, so a url captured very often does not
pile up).  Cards without a url match no page and are kept out of the join, so
they do not meet on one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import capture as C
from rentgrid.functions import patterns as P
from rentgrid.functions.dialect import SPARK

CARD_COLUMNS = ["id", "source", "url", "title", "price", "location", "posted_date", "listing_type",
                "extracted_at", "listing_key", "snapshot_no"]
FLAG_COLUMNS = ["furnished", "pets_allowed", "laundry_in_unit", "parking_included", "utilities_included"]
DETAIL_COLUMNS = ["description", "image_urls", "latitude", "longitude", *FLAG_COLUMNS, "square_feet"]


def latest_details(captures: DataFrame, order: list[str]) -> DataFrame:
    """One detail row per url: the newest capture by ``order``."""
    pages = captures.filter(F.col("url") != "")
    row = F.struct(*[F.col(c) for c in DETAIL_COLUMNS])
    return (pages.groupBy("url").agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("_d"))
                 .select("url", "_d.*"))


def attach_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Cards with what their detail pages add."""
    page = F.struct(*[F.col(c) for c in DETAIL_COLUMNS]).alias("_page")
    cards = cards.select(*CARD_COLUMNS, *DETAIL_COLUMNS)
    has_url = F.coalesce(F.col("url"), F.lit("")) != ""
    joined = cards.filter(has_url).join(details.select("url", page), "url", "left").select(
        *CARD_COLUMNS, *DETAIL_COLUMNS, "_page")
    first_site = F.col("source") == "craigslist"
    read = F.col("_page").isNotNull()
    newer = {c: F.coalesce(F.col(f"_page.{c}"), F.col(c)) for c in ("description", "latitude", "longitude", "square_feet")}
    # a page only ever sets a flag
    newer |= {c: F.coalesce(F.when(F.col(f"_page.{c}"), F.lit(True)), F.col(c)) for c in FLAG_COLUMNS}
    found = F.coalesce(F.col("_page.image_urls"), F.array().cast("array<string>"))
    newer["image_urls"] = F.when(read & first_site, F.concat(F.col("image_urls"), found)).when(read, found).otherwise(
        F.col("image_urls"))
    text = F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce(newer["description"], F.lit(""))))
    newer["listing_type"] = F.when(read & first_site, C.classify_listing_type(
        SPARK, text, F.col("listing_type"), P.LISTING_TYPE_RULES_A)).otherwise(F.col("listing_type"))
    out = joined.select(*[newer.get(c, F.col(c)).alias(c) for c in CARD_COLUMNS + DETAIL_COLUMNS])
    return out.unionByName(cards.filter(~has_url))
