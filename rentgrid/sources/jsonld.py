"""Search pages with embedded JSON-LD -> listings (A1, A2).

``decode_pages``: the body of ``<script id="ld_searchpage_results">`` is
parsed as VARIANT; an object contributes its ``itemListElement`` array, an
array contributes itself, anything else (or bad JSON) no rows.  Each item:

* title = ``name``, url, description as given;
* price: ``offers.price`` else ``offers.priceCurrency`` (first truthy),
  else top-level ``price``, each read by the price-text rules (so a bare
  number without ``$`` or ``/mo`` gives NULL);
* location = non-empty ``addressLocality`` and ``addressRegion`` joined by
  ``", "``;
* coordinates: a truthy latitude is read first, then the longitude; a bad
  latitude leaves both NULL, a bad longitude keeps the latitude;
* posted date from ``datePosted`` else ``datePublished`` (ISO, ``Z`` ok);
* images: a string or an array, strings starting with ``http`` kept;
* id ``cl-<digits>`` from ``/<digits>.html`` in the url;
* type ``room_private`` re-classified from title and description;
* items without a title are dropped.

``encode_pages`` builds such pages from captured listings (120 items per
page, bounded groups), used to exercise the decoder on the test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import capture as C
from rentgrid.functions import patterns as P
from rentgrid.functions.dialect import SPARK
from rentgrid.functions.extract import extract_price
from rentgrid.schema import as_listings

#: The script is found by its id, wherever that stands in the tag and however it is quoted.
SCRIPT_PATTERN = (r"""(?is)<script\b(?=[^>]*?\sid\s*=\s*(?:"ld_searchpage_results"|'ld_searchpage_results'"""
                  r"""|ld_searchpage_results[\s>]))[^>]*>(.*?)</script>""")
ITEMS_PER_PAGE = 120


def _get(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


def _truthy(v: Column, path: str) -> Column:
    """The value at ``path`` as text when Python would find it truthy
    (non-empty string, non-zero number, true), else NULL."""
    raw = F.variant_get(v, path, "variant")
    kind = F.schema_of_variant(raw)
    text = F.try_variant_get(v, path, "string")
    num = F.try_variant_get(v, path, "double")
    return (F.when(kind == "STRING", F.when(text != "", text))
             .when(kind == "BOOLEAN", F.when(text == "true", text))
             .when(kind.isin("NULL", "OBJECT") | kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(None))
             .otherwise(F.when(num != 0, text)))


def decode_pages(pages: DataFrame, page_col: str = "page_id", html_col: str = "html") -> DataFrame:
    body = F.regexp_extract(F.col(html_col), SCRIPT_PATTERN, 1)
    # parse once per page into a VARIANT column; items are read from it
    parsed = pages.select(page_col, F.try_parse_json(F.when(body != "", body)).alias("_v"))
    v = F.col("_v")
    items = F.coalesce(_get(v, "$.itemListElement", "array<variant>"),
                       F.when(F.schema_of_variant(v).startswith("ARRAY"), _get(v, "$", "array<variant>")))
    exploded = parsed.select(page_col, F.posexplode(items).alias("pos", "item"))
    it = F.col("item")
    offer_price = F.coalesce(_truthy(it, "$.offers.price"), _truthy(it, "$.offers.priceCurrency"))
    from_offer = extract_price(SPARK, offer_price)
    price = F.coalesce(from_offer, extract_price(SPARK, _truthy(it, "$.price")))
    loc_parts = F.array_compact(F.array(F.nullif(_get(it, "$.address.addressLocality"), F.lit("")),
                                        F.nullif(_get(it, "$.address.addressRegion"), F.lit(""))))
    lat_t = _truthy(it, "$.geo.latitude")
    lon_t = _truthy(it, "$.geo.longitude")
    lat = lat_t.try_cast("double")
    lon = F.when(lat_t.isNull() | lat.isNotNull(), lon_t.try_cast("double"))
    date_text = F.coalesce(_truthy(it, "$.datePosted"), _truthy(it, "$.datePublished"))
    image_one = _get(it, "$.image", "string")
    image_arr = F.when(F.schema_of_variant(F.variant_get(it, "$.image", "variant")).startswith("ARRAY"),
                       F.transform(_get(it, "$.image", "array<variant>"),
                                   lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))))
    images = F.coalesce(F.when(image_one.isNotNull() & ~F.schema_of_variant(
        F.variant_get(it, "$.image", "variant")).startswith("ARRAY"), F.array(image_one)), image_arr,
        F.array().cast("array<string>"))
    url = F.coalesce(_get(it, "$.url"), F.lit(""))
    title = F.coalesce(_get(it, "$.name"), F.lit(""))
    description = F.coalesce(_get(it, "$.description"), F.lit(""))
    out = exploded.select(
        page_col, "pos",
        F.coalesce(C.id_from_url(SPARK, url, P.CRAIGSLIST_ID_PATTERN, "cl-"),
                   SPARK.sha_id("cl-", url, title, description)).alias("id"),
        F.lit("craigslist").alias("source"), url.alias("url"), title.alias("title"), price.alias("price"),
        F.array_join(loc_parts, ", ").alias("location"),
        lat.alias("latitude"), F.when(lat_t.isNull() | lat.isNotNull(), lon).alias("longitude"),
        description.alias("description"),
        SPARK.try_iso_timestamp(date_text).alias("posted_date"),
        F.filter(images, lambda s: s.startswith("http")).alias("image_urls"),
    )
    typed = out.withColumn("listing_type", C.classify_listing_type(
        SPARK, F.lower(F.concat(F.col("title"), F.lit(" "), F.col("description"))), F.lit("room_private"),
        P.LISTING_TYPE_RULES_A))
    return as_listings(typed.filter(F.length("title") > 0), keep=[page_col, "pos"])


def encode_pages(raw: DataFrame) -> DataFrame:
    """Captured listings -> search pages of up to 120 JSON-LD items.

    Page shapes rotate: object with ``itemListElement``, bare array, and
    (every fifth page) a body that is not JSON.
    """
    item = F.to_json(F.struct(
        F.col("title_text").alias("name"),
        C.absolute_url(SPARK, F.col("href"), P.CRAIGSLIST_BASE_URL).alias("url"),
        F.col("description_text").alias("description"),
        F.struct(F.col("price_text").alias("price")).alias("offers"),
        F.struct(F.col("location_text").alias("addressLocality"), F.lit("BC").alias("addressRegion"))
        .alias("address"),
        F.struct(F.col("lat_text").alias("latitude"), F.col("lon_text").alias("longitude")).alias("geo"),
        F.col("date_attr").alias("datePosted"),
        F.split(F.col("images_text"), r"\|").alias("image"),
    ))
    items = raw.select((F.col("listing_key") / ITEMS_PER_PAGE).cast("bigint").alias("page_id"),
                       "listing_key", item.alias("item"))
    grouped = items.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("listing_key", "item"))),
                                 lambda s: s["item"]), ",").alias("items"))
    body = (F.when(F.col("page_id") % 5 == 4, F.lit("{not json"))
             .when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"@type": "ItemList", "itemListElement": ['),
                                                      F.col("items"), F.lit("]}")))
             .otherwise(F.concat(F.lit("["), F.col("items"), F.lit("]"))))
    tag = (F.when(F.col("page_id") % 3 == 0, F.lit("<script id='ld_searchpage_results' type='application/ld+json'>"))
            .when(F.col("page_id") % 3 == 1, F.lit('<script type="application/ld+json" id="ld_searchpage_results">'))
            .otherwise(F.lit('<script id="ld_searchpage_results" type="application/ld+json">')))
    html = F.concat(F.lit("<html><body><script>var x = 1;</script>"), tag,
                    body, F.lit("</script></body></html>"))
    return grouped.select("page_id", html.alias("html"))
