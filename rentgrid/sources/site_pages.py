"""Result cards and detail pages of both sites, from raw HTML.

What is read is declared below; ``selectors.read_records`` reads it in Arrow
batches, and the texts are decoded by the same expressions as other captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import capture as C
from rentgrid.functions.dialect import SPARK
from rentgrid.functions.extract import clean_text
from rentgrid.sources import captures
from rentgrid.sources.selectors import Field, Record, read_records

# The sites' own marks, as their pages have them.
CRAIGSLIST_CARDS = Record(
    ("div.cl-search-result, li.cl-search-result, .result-row", ".cl-search-result"),
    {"title_text": Field("a.titlestring, a.posting-title, a.result-title, .title-blob a, a.cl-app-anchor"),
     "href": Field("a.titlestring, a.posting-title, a.result-title, .title-blob a, a.cl-app-anchor", ("href",)),
     "price_text": Field(".priceinfo, .price, .result-price, .meta .price"),
     "location_text": Field(".meta .subreddit, .result-hood, .neighborhoods, .location, .meta .nearby"),
     "date_attr": Field("time, .date, .result-date", ("datetime",)),
     "date_text": Field("time, .date, .result-date"),
     "pid": Field("", ("data-pid",))})
KIJIJI_CARDS = Record(
    ('[data-testid="listing-card"], [data-testid="search-listing-card"], .search-item, [data-listing-id]',),
    {"title_text": Field('[data-testid="listing-title"], [data-testid="listing-link"], a.title, .title a, h3 a'),
     "href": Field('[data-testid="listing-title"], [data-testid="listing-link"], a.title, .title a, h3 a', ("href",)),
     "price_text": Field('[data-testid="listing-price"], .price, [class*="price"]'),
     "location_text": Field('[data-testid="listing-location"], .location, [class*="location"]'),
     "date_text": Field('[data-testid="listing-date"], .date-posted, [class*="date"]'),
     "description_text": Field('[data-testid="listing-description"], .description, [class*="description"]'),
     "image": Field("img[src], picture img", ("src",))})
CRAIGSLIST_DETAIL = Record(
    (), {"description": Field("#postingbody"),
         "images": Field("#thumbs a, .gallery img, .swipe img", ("href", "src"), True),
         "lat_text": Field("#map", ("data-latitude",)), "lon_text": Field("#map", ("data-longitude",)),
         "attrs": Field(".mapAndAttrs .attrgroup span", (), True)})
KIJIJI_DETAIL = Record(
    (), {"description": Field('[data-testid="listing-description"], #vip-body, [class*="descriptionContainer"], .description'),
         "images": Field('[data-testid="gallery-image"] img, .gallery img, [class*="imageGallery"] img', ("src",), True),
         "lat_text": Field('[data-testid="map"], #MapContainer, .mapContainer', ("data-lat", "data-latitude")),
         "lon_text": Field('[data-testid="map"], #MapContainer, .mapContainer', ("data-lng", "data-longitude")),
         "attrs": Field('[data-testid="attribute-row"], .attributeList li, [class*="attributeGroupContainer"] li', (), True)})

_TEXTS = ("title_text", "href", "price_text", "location_text", "date_attr", "date_text", "pid", "description_text",
          "attrs_text", "images_text", "lat_text", "lon_text", "model_type")
_NULL = {"model_price": "int", "captured_pets": "boolean", "captured_bedrooms": "int", "extracted_at": "timestamp", "snapshot_no": "int"}
CARDS = {"craigslist": CRAIGSLIST_CARDS, "kijiji": KIJIJI_CARDS}
DETAILS = {"craigslist": CRAIGSLIST_DETAIL, "kijiji": KIJIJI_DETAIL}


def decode_cards(pages: DataFrame, site: str, as_of: str, page_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Listings of the result cards of a site's search pages, with the page and
    the card's position on it.  A card without a title is no listing."""
    cards = read_records(pages, CARDS[site], page_col, html_col)
    texts = {c: F.coalesce(F.col(c), F.lit("")) if c in cards.columns else F.lit("") for c in _TEXTS}
    # the decoder keeps the key of a capture; the place of the card is sent through as such
    key = F.struct(F.col(page_col).alias("page"), F.col("pos").alias("pos"), F.col("image").alias("image")
                   if "image" in cards.columns else F.lit(None).cast("string").alias("image")).alias("listing_key")
    raw = cards.select(key, F.lit(site).alias("source"), *[e.alias(c) for c, e in texts.items()],
                       *[F.lit(None).cast(t).alias(c) for c, t in _NULL.items()])
    out = captures.decode(raw, as_of)
    if site == "craigslist":
        out = out.withColumn("listing_type", F.lit("room_private"))  # a card's type is read on its detail page
    image = F.col("listing_key.image")
    return out.withColumns({
        "image_urls": F.when(image.startswith("http"), F.array(image)).otherwise(F.array().cast("array<string>")),
        page_col: F.col("listing_key.page"), "pos": F.col("listing_key.pos")}).drop("listing_key", "snapshot_no")


def decode_details(pages: DataFrame, site: str, url_col: str = "url", html_col: str = "html", keep: tuple = ()) -> DataFrame:
    """What a site's detail pages say of the listing of their url, as
    ``details.attach_details`` takes it: NULL where the page has nothing."""
    page = F.struct(F.col(url_col).alias("url"), *keep).alias("page")
    read = read_records(pages.select(page, html_col), DETAILS[site], "page", html_col)
    first = site == "craigslist"
    flags = (C.craigslist_attr_flags if first else C.kijiji_attr_flags)(SPARK, F.col("attrs"))
    text = F.col("description")
    text = clean_text(SPARK, C.strip_qr_boilerplate(SPARK, text) if first else text)
    lat, lon = C.coordinates(SPARK, *[F.coalesce(F.col(c), F.lit("")) for c in ("lat_text", "lon_text")])
    return read.select("page.*", F.when(F.col("description").isNotNull(), text).alias("description"),
                       C.http_images(SPARK, F.col("images"), drop_placeholder=not first).alias("image_urls"),
                       lat.alias("latitude"), lon.alias("longitude"), *[e.alias(c) for c, e in flags.items()])


# --------------------------------------------------------------------------
# Pages made of captures, which the queries read
# --------------------------------------------------------------------------


def _escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _tag(column: str, before: str, after: str) -> list[Column]:
    return [F.lit(before), _escaped(F.col(column)), F.lit(after)]


def _card(number: Column, site: str) -> Column:
    """A card's markup; three forms, so that every kind of selector is used."""
    first_image = F.element_at(F.split("images_text", r"\|"), 1)
    if site == "craigslist":
        forms = [
            [F.lit('<li class="cl-search-result x" data-pid="'), F.col("pid"), *_tag("href", '"><a class="main" href="#">Save</a><div class="title-blob"><a href="', '">'),
             *_tag("title_text", "<span>", "</span></a></div>"), *_tag("price_text", '<span class="priceinfo">', "</span>"),
             *_tag("location_text", '<div class="meta"><i>in</i> <span class="nearby">', "</span>"),
             *_tag("date_attr", '<time datetime="', '">'), *_tag("date_text", "", "</time></div></li>")],
            [F.lit('<div class="result-row" data-pid="'), F.col("pid"), *_tag("date_attr", '"><span class="result-date" datetime="', '">'),
             *_tag("date_text", "", "</span>"), *_tag("href", '<h3><a class="result-title hdrlnk" href="', '">'), *_tag("title_text", "", "</a></h3>"),
             *_tag("price_text", "<b class='result-price'>", "</b>"), *_tag("location_text", "<small class=result-hood>", "</small></div>")]]
    else:
        forms = [
            [F.lit('<section data-testid="listing-card"><picture><img src="'), _escaped(first_image), *_tag("href", '"></picture><h3><a data-testid="listing-link" href="', '">'),
             *_tag("title_text", "", "</a></h3>"), *_tag("price_text", '<p data-testid="listing-price"><b>', "</b></p>"),
             *_tag("location_text", '<span data-testid="listing-location">', "</span>"), *_tag("date_text", '<p data-testid="listing-date">', "</p>"),
             *_tag("description_text", '<p data-testid="listing-description">', "</p></section>")],
            [*_tag("href", '<div class="search-item top"><div class="title"><a href="', '">'), *_tag("title_text", "", "</a></div>"),
             *_tag("price_text", '<div class="price">', "</div>"), *_tag("location_text", '<div class="location">', "</div>"),
             *_tag("date_text", '<span class="date-posted">', "</span>"), *_tag("description_text", '<div class="description">', "</div>"),
             F.lit('<img alt="" src="'), _escaped(first_image), F.lit('"></div>')],
            [F.lit('<li data-listing-id="'), number.cast("string"), *_tag("href", '"><h3><a href="', '">'), *_tag("title_text", "", "</a></h3>"),
             *_tag("price_text", '<div class="itm-price-x">', "</div>"), *_tag("location_text", '<em class="the-location">', "</em>"),
             *_tag("date_text", '<em class="my-date">', "</em>"), *_tag("description_text", '<p class="short-description">', "<script>var a = '<b>';</script></p>"),
             F.lit('<img src="'), _escaped(first_image), F.lit('"></li>')]]
    out = F.when(F.lit(False), F.lit(""))
    for i, parts in enumerate(forms):
        out = out.when(number % len(forms) == i, F.concat(*parts))
    return out


def encode_cards(raw: DataFrame, site: str, per_page: int) -> DataFrame:
    """Captures -> ``page_id, cards``: the markup of up to ``per_page`` cards."""
    cards = raw.select(F.floor(F.col("listing_key") / per_page).alias("page_id"), "listing_key", _card(F.col("listing_key"), site).alias("card"))
    grouped = cards.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("listing_key", "card"))).alias("all"))
    return grouped.select("page_id", F.array_join(F.col("all.card"), "\n").alias("cards"))


def encode_details(raw: DataFrame, site: str) -> DataFrame:
    """Captures -> ``listing_key, url, html`` of their detail pages."""
    many = lambda column, each: F.array_join(F.transform(F.split(column, r"\|"), each), "")
    if site == "craigslist":
        parts = [*_tag("description_text", '<section id="postingbody" class="body">', "</section>"), F.lit('<div id="thumbs">'),
                 many("images_text", lambda s: F.concat(F.lit('<a href="'), _escaped(s), F.lit('"><img src="http://t.example/x.jpg"></a>'))),
                 *_tag("lat_text", '</div><div class="mapAndAttrs"><div id="map" data-latitude="', '"'), *_tag("lon_text", ' data-longitude="', '"></div>'),
                 F.lit('<p class="attrgroup">'), many("attrs_text", lambda s: F.concat(F.lit("<span>"), _escaped(s), F.lit("</span><br>"))), F.lit("</p></div>")]
    else:
        number = F.col("listing_key")
        parts = [F.when(number % 2 == 0, F.lit('<div id="vip-body">')).otherwise(F.lit('<div class="x descriptionContainer-1">')),
                 *_tag("description_text", "", "</div>"), F.when(number % 2 == 0, F.lit('<div class="gallery">')).otherwise(F.lit('<div class="imageGallery-9">')),
                 many("images_text", lambda s: F.concat(F.lit('<img src="'), _escaped(s), F.lit('">'))), F.lit("</div>"),
                 F.when(number % 2 == 0, F.lit('<ul class="attributeList">')).otherwise(F.lit('<ul class="attributeGroupContainer-2">')),
                 many("attrs_text", lambda s: F.concat(F.lit("<li>"), _escaped(s))), *_tag("lat_text", '</ul><div class="mapContainer" data-latitude="', '"'),
                 *_tag("lon_text", ' data-longitude="', '"></div>')]
    html = F.concat(F.lit("<html><head><title>x</title><style>.a{}</style></head><body>"), *parts, F.lit("</body></html>"))
    return raw.select("listing_key", F.col("href").alias("url"), html.alias("html"))
