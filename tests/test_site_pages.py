"""Cards and detail pages from raw HTML by declared selectors."""

import datetime as dt

import pytest

from rentgrid.sources import site_pages
from rentgrid.sources.details import attach_details
from rentgrid.sources.selectors import Field, Record, _Page, matcher, read_records

AS_OF = "2026-12-01 12:00:00"
HTML = """<!doctype html><div class="outer title big"><p id=x data-k="v1 v2">a<b>b</b><p>c <a href=u class="one  two">l&amp;m</a>
<ul><li>i<li>j<br>k</ul></div><h3><span><a href="">deep</a></span></h3><script>var s = "<p id='no'>";</script><img src=s.png alt>"""


def texts(selector, html=HTML):
    page = _Page()
    page.feed(html)
    page.close()
    match = matcher(selector)
    return [" ".join("".join(page.texts[e.start:e.end]).split()) for e in page.elements if match(e)]


@pytest.mark.parametrize("selector,found", [
    ("p", ["ab", "c l&m"]), ("#x", ["ab"]), (".title a", ["l&m"]), ("a.one.two", ["l&m"]), ("a.on", []), ("h3 a", ["deep"]), ("div h3 a", []),
    ('[data-k="v1 v2"] b', ["b"]), ('[data-k="v1"]', []), ('[data-k*="1 v"]', ["ab"]), ("li", ["i", "j k"]), (".big .title", []),
    (".outer ul li, #x", ["ab", "i", "j k"]), ("[href]", ["l&m", "deep"]), ("img[src]", [""]), ("script", [""])])
def test_selectors(selector, found):
    assert texts(selector) == found


def test_bad_selectors_are_reported():
    with pytest.raises(ValueError):
        matcher("a > b:hover")


def test_records(spark):
    record = Record((".none", ".card"), {"own": Field("", ("data-id",)), "t": Field("b"), "all": Field("i", (), True), "u": Field("a", ("x", "href"))})
    pages = [(1, '<div class=card data-id=7><b>one</b><b>two</b><i>p</i><i>q</i><a href=h></a></div><div class="card"></div>'), (1, None), (None, ""),
             (3, "<div class=card><div class=card><b>in</b></div></div>" + "<p>x</p>" * 3000), (4, "<<<>&&</b></div><b")]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(2)
    got = sorted((tuple(r) for r in read_records(df, record).collect()), key=str)
    assert got == sorted([(1, 0, "7", "one", ["p", "q"], "h"), (1, 1, "", None, [], None), (3, 0, "", "in", [], None), (3, 1, "", "in", [], None)], key=str)
    # without lists every page is one record, also an empty one
    assert read_records(df, Record((), record.fields)).count() == len(pages)


def test_second_site_cards(spark):
    cards = """<ul><li data-listing-id="5"><h3><a href="/v-room/x/1234">Studio &amp; den</a></h3><p class="the-price">$1,250</p>
<span class="some-location">Kits</span><span class="posted-date">Nov 5</span><div class="my-description">Basement suite<br>near UBC</div><img src="/local.png"></li>
<section data-testid="listing-card"><a data-testid="listing-link">No link</a><img src="https://i.example/placeholder.jpg"></section>
<div class="search-item"><p class="price">$900</p></div></ul>"""
    got = site_pages.decode_cards(spark.createDataFrame([(9, cards), (10, None), (11, "<p>none</p>")], "page_id long, html string"), "kijiji", AS_OF).collect()
    one, two = sorted(got, key=lambda r: r.pos)
    assert (one.id, one.url, one.title, one.price, one.location, one.description, one.listing_type, one.image_urls) == (
        "kj-1234", "https://www.kijiji.ca/v-room/x/1234", "Studio & den", 1250, "Kits", "Basement suite near UBC", "basement_suite", [])
    assert one.posted_date == dt.datetime(2026, 11, 5) and (one.page_id, one.pos) == (9, 0)
    assert (two.title, two.url, two.price, two.image_urls, two.listing_type) == ("No link", "", None, ["https://i.example/placeholder.jpg"], "room_private")


def test_details_join_cards(spark):
    first = """<section id="postingbody">QR Code Link to This Post
Studio  near <b>UBC</b></section><div class="gallery"><img src="https://i/1.jpg"><img src="/rel.jpg"></div><div id="map" data-latitude="49.2" data-longitude="-123"></div>
<div class="mapAndAttrs"><p class="attrgroup"><span>Cats are OK</span><span>650ft2</span></p></div><p class="attrgroup"><span>garage</span></p>"""
    second = """<div class="descriptionContainer-3">Full text</div><div class="imageGallery-1"><img src="https://i/placeholder.png"><img src="https://i/2.jpg"></div>
<ul class="attributeList"><li>Pet friendly: Yes<li>Size (sqft): 512 sq</ul><div class="mapContainer" data-lat="bad" data-lng="-123"></div>"""
    one = site_pages.decode_details(spark.createDataFrame([("u1", first), ("e", None)], "url string, html string"), "craigslist")
    two = site_pages.decode_details(spark.createDataFrame([("u2", second)], "url string, html string"), "kijiji")
    rows = {r.url: r for r in one.unionByName(two).collect()}
    assert (rows["u1"].description, rows["u1"].image_urls, rows["u1"].latitude, rows["u1"].pets_allowed, rows["u1"].square_feet, rows["u1"].parking_included) == (
        "Studio near UBC", ["https://i/1.jpg"], 49.2, True, 650, None)
    assert (rows["u2"].description, rows["u2"].image_urls, rows["u2"].latitude, rows["u2"].longitude, rows["u2"].pets_allowed, rows["u2"].square_feet) == (
        "Full text", ["https://i/2.jpg"], None, None, True, 512)
    assert rows["e"].description is None and rows["e"].image_urls == []
    card = '<li class="cl-search-result" data-pid="1"><a class="titlestring" href="https://c/1.html">Room</a></li>'
    cards = site_pages.decode_cards(spark.createDataFrame([(1, card)], "page_id long, html string"), "craigslist", AS_OF)
    from pyspark.sql import functions as F
    cards = cards.withColumns({"listing_key": F.lit(1), "snapshot_no": F.lit(1), "url": F.lit("u1")})
    got = attach_details(cards, one).first()
    assert (got.title, got.description, got.listing_type, got.square_feet) == ("Room", "Studio near UBC", "studio", 650)


def test_large_pages_are_read_in_one_pass(spark):
    """A page of 4,000 cards: each card looks at its own elements only."""
    card = '<li class="cl-search-result" data-pid="{0}"><a class="titlestring" href="/{0}.html">Room {0}</a><b class=price>$900</b></li>'
    page = "<ul>" + "".join(card.format(i) for i in range(4000)) + "</ul>"
    out = site_pages.decode_cards(spark.createDataFrame([(1, page)], "page_id long, html string"), "craigslist", AS_OF)
    assert out.selectExpr("count(*)", "count(DISTINCT id)", "min(price)").first()[:] == (4000, 4000, 900)
