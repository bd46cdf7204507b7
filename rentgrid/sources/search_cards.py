"""Search pages -> listings, with the result cards where the JSON gives none (A4).

Per page, the embedded JSON is read first (``jsonld.decode_pages``); the cards
of the pages that gave no row that way are read by ``site_pages.decode_cards``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.sources import jsonld, site_pages


def decode_search_pages(pages: DataFrame, as_of: str, page_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Listings of the embedded JSON, and of the cards of every page whose JSON gave none."""
    found = jsonld.decode_pages(pages, page_col, html_col)
    done = found.select(F.col(page_col).alias("_done")).distinct()
    left = pages.join(done, F.col(page_col).eqNullSafe(F.col("_done")), "left_anti")
    return found.unionByName(site_pages.decode_cards(left, "craigslist", as_of, page_col, html_col).select(found.columns))
