"""Captured listing records -> the listing schema.

A captured record carries the raw texts a source page or post gave (title,
link, price text, location text, date attribute / date text, description,
detail attribute rows, image links, coordinates).  ``decode_columns(d)``
maps them, per source, to the 55 listing columns:

* craigslist: card + detail page -- absolute url, ``data-pid`` or url id,
  price text parsed, location stripped of parentheses, ISO date attribute
  else relative date, description without the QR boilerplate, images
  appended, attribute blob flags, square feet, coordinates, listing type
  variant A over the default ``room_private``;
* kijiji: card + detail page -- url id, relative date, images replaced by
  the detail set without placeholders, per-row attribute flags, listing
  type variant B;
* facebook: a model answer -- price taken as given, type mapped to the
  closed set, and no text enrichment apart from the neighbourhood.

Derived text columns are added afterwards by ``operators.enrich``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import capture as C
from rentgrid.functions import patterns as P
from rentgrid.functions.dialect import DUCK, SPARK
from rentgrid.functions.extract import PARSED_COLUMNS, clean_text, extract_price
from rentgrid.functions.stages import apply_stages, cached, stages_sql
from rentgrid.schema import LISTING_FIELDS


def decode_stages(d, as_of) -> tuple[list[dict], dict]:
    """(intermediate stages, final projection) mapping captures to listings."""
    src = d.col("source")
    is_cl = d.eq(src, "craigslist")
    is_kj = d.eq(src, "kijiji")

    def by_source(cl, kj, fb):
        return d.case([(is_cl, cl), (is_kj, kj)], fb)

    # Spark: a column of its own, as the cleaning reads it more than once
    s0, qr_free = {}, C.strip_qr_boilerplate(d, d.col("description_text"))
    if d.name == "spark":
        s0, qr_free = {"_qr_free": d.case([(is_cl, qr_free)], d.null("string"))}, d.col("_qr_free")
    s1 = {
        "_title": by_source(clean_text(d, d.col("title_text")), clean_text(d, d.col("title_text")),
                            d.col("title_text")),
        "_url": by_source(C.absolute_url(d, d.col("href"), P.CRAIGSLIST_BASE_URL),
                          C.absolute_url(d, d.col("href"), P.KIJIJI_BASE_URL), d.col("href")),
        "_location": by_source(d.btrim(clean_text(d, d.col("location_text")), "() "),
                               clean_text(d, d.col("location_text")), d.col("location_text")),
        "_description": by_source(clean_text(d, qr_free),
                                  clean_text(d, d.col("description_text")), d.col("description_text")),
        "_date_in": by_source(d.col("date_text"), clean_text(d, d.col("date_text")), d.lit("")),
        "_attrs": d.split(d.col("attrs_text"), "|"),
        "_images": d.split(d.col("images_text"), "|"),
        "_stable_id": d.concat(by_source(d.lit("cl-"), d.lit("kj-"), d.lit("fb-")), d.sha_id(
            "", src, d.col("href"), d.col("title_text"), d.col("description_text"))),
    }
    s2 = {"_type_text": d.lower(d.concat(d.col("_title"), d.lit(" "), d.col("_description")))}
    date_stages = C.relative_date_stages(d, d.col("_date_in"), as_of, "_rd")
    stages = ([s0] if s0 else []) + [s1, s2] + date_stages

    url = d.col("_url")
    pid = d.col("pid")
    stable = d.col("_stable_id")
    cl_id = d.case([(d.ne(pid, ""), d.concat(d.lit("cl-"), pid))],
                   d.coalesce(C.id_from_url(d, url, P.CRAIGSLIST_ID_PATTERN, "cl-"), stable))
    kj_id = d.coalesce(C.id_from_url(d, url, P.KIJIJI_ID_PATTERN, "kj-"), stable)
    posted = by_source(
        d.coalesce(C.iso_timestamp(d, d.nullif_empty(d.col("date_attr"))), d.col("_rd")),
        d.col("_rd"),
        d.null("timestamp"))
    type_text = d.col("_type_text")
    listing_type = by_source(
        C.classify_listing_type(d, type_text, d.lit("room_private"), P.LISTING_TYPE_RULES_A),
        C.classify_listing_type(d, type_text, d.lit("room_private"), P.LISTING_TYPE_RULES_B),
        C.map_listing_type(d, d.col("model_type")))
    attrs = d.col("_attrs")
    images = d.col("_images")
    cl_flags = C.craigslist_attr_flags(d, attrs)
    kj_flags = C.kijiji_attr_flags(d, attrs)
    lat, lon = C.coordinates(d, d.col("lat_text"), d.col("lon_text"))
    fb_pets = d.col("captured_pets")
    fb_beds = d.col("captured_bedrooms")
    price_from_text = extract_price(d, d.col("price_text"), (s1, s2) if d.name == "spark" else None)

    cols = {
        "id": by_source(cl_id, kj_id, stable),
        "source": src,
        "url": url,
        "title": d.col("_title"),
        "price": d.case([(d.eq(src, "facebook"), d.col("model_price"))], price_from_text),
        "location": d.col("_location"),
        "latitude": by_source(lat, lat, d.null("double")),
        "longitude": by_source(lon, lon, d.null("double")),
        "description": d.col("_description"),
        "posted_date": posted,
        "available_date": d.null("timestamp"),
        "extracted_at": d.col("extracted_at"),
        "listing_type": listing_type,
        "num_bedrooms": by_source(d.null("int"), d.null("int"), fb_beds),
        "num_bathrooms": d.null("int"),
        "num_roommates": d.null("int"),
        "square_feet": by_source(cl_flags["square_feet"], kj_flags["square_feet"], d.null("int")),
        "utilities_included": by_source(cl_flags["utilities_included"], kj_flags["utilities_included"],
                                        d.null("boolean")),
        "furnished": by_source(cl_flags["furnished"], kj_flags["furnished"], d.null("boolean")),
        "pets_allowed": by_source(d.coalesce(cl_flags["pets_allowed"], fb_pets),
                                  d.coalesce(kj_flags["pets_allowed"], fb_pets), fb_pets),
        "parking_included": by_source(cl_flags["parking_included"], kj_flags["parking_included"],
                                      d.null("boolean")),
        "laundry_in_unit": by_source(cl_flags["laundry_in_unit"], kj_flags["laundry_in_unit"],
                                     d.null("boolean")),
        "image_urls": by_source(C.http_images(d, images), C.http_images(d, images, drop_placeholder=True),
                                d.split(d.lit(""), "|")),
    }
    for name, sql_type in PARSED_COLUMNS:
        if name not in cols:
            cols[name] = d.null(sql_type)
    final = {name: cols[name] for name, _ in LISTING_FIELDS}
    # capture metadata kept for snapshot merge, upsert order and run logs
    final["listing_key"] = d.col("listing_key")
    final["snapshot_no"] = d.col("snapshot_no")
    return stages, final


def decode(raw: DataFrame, as_of: str) -> DataFrame:
    """Spark: captured records -> listings (55 columns, derived ones NULL).
    A card without a title is no listing; a post without one is."""
    stages, final = cached(("decode", as_of), lambda: decode_stages(SPARK, SPARK.ts_lit(as_of)))
    return apply_stages(raw, stages, final).filter((F.col("source") == "facebook") | (F.col("title") != ""))


def decode_sql(raw_relation: str, as_of: str) -> str:
    stages, final = decode_stages(DUCK, DUCK.ts_lit(as_of))
    return f"SELECT * FROM ({stages_sql(raw_relation, stages, final)}) WHERE source = 'facebook' OR title <> ''"
