"""Capture clean-up functions, merge rules, keyed state, statistics, dedup."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentgrid.functions import capture as C
from rentgrid.functions.dialect import SPARK
from rentgrid.functions.extract import clean_text, extract_price
from rentgrid.functions.stages import apply_stages

PRICES = [
    ("$1,200/month", 1200), ("$1200", 1200), ("1,200/mo", 1200), ("850 / month", 850),
    ("1100 per month", 1100), ("950 a month", 950), ("$ 700", 700), ("$100", 100), ("$10,000", 10000),
    ("$50", None), ("$15,000", None), ("Rent $900 or $1000", 900), ("$50 deposit, 800/mo", 800),
    ("", None), (None, None), ("call for price", None), ("$,", None),
]


def test_extract_price(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PRICES)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", extract_price(SPARK, F.col("t")).alias("p")).collect()}
    for i, (text, expected) in enumerate(PRICES):
        assert got[i] == expected, text


AS_OF = dt.datetime(2026, 12, 1, 12, 0, 0)
DATES = [
    ("just now", AS_OF), ("Moments ago", AS_OF), ("5 minutes ago", AS_OF - dt.timedelta(minutes=5)),
    ("an hour ago", AS_OF - dt.timedelta(hours=1)), ("a day ago", AS_OF - dt.timedelta(days=1)),
    ("3 hours ago", AS_OF - dt.timedelta(hours=3)), ("2 weeks ago", AS_OF - dt.timedelta(weeks=2)),
    ("1 month ago", AS_OF - dt.timedelta(days=30)), ("10 seconds ago", AS_OF - dt.timedelta(seconds=10)),
    ("today", dt.datetime(2026, 12, 1)), ("yesterday", dt.datetime(2026, 11, 30)),
    ("", None), ("whenever", None), ("2026-11-02", dt.datetime(2026, 11, 2)),
    ("30000 seconds ago", AS_OF - dt.timedelta(seconds=30000)), ("40000 minutes ago", AS_OF - dt.timedelta(minutes=40000)),
    ("30000 hours ago", AS_OF - dt.timedelta(hours=30000)), ("99999999999999999999 days ago", None),
    ("9223372036854775807 months ago", None), ("Nov 3, 2026", dt.datetime(2026, 11, 3)),
    ("November 3, 2026", dt.datetime(2026, 11, 3)), ("3 November 2026", dt.datetime(2026, 11, 3)),
    ("3 Nov 2026", dt.datetime(2026, 11, 3)), ("11/02/2026", dt.datetime(2026, 11, 2)),
    ("2026-11-20T10:15:00Z", dt.datetime(2026, 11, 20, 10, 15)), ("2026", None), ("2026-11", dt.datetime(2026, 11, 1)),
    ("10:15", dt.datetime(2026, 12, 1, 10, 15)), ("13/5", dt.datetime(2026, 5, 13)),
    ("20261120", dt.datetime(2026, 11, 20)), ("99999999", None),
]


def test_relative_date(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    stages = C.relative_date_stages(SPARK, F.col("t"), F.lit(AS_OF), "_rd")
    out = apply_stages(df, stages, {"i": F.col("i"), "d": F.col("_rd")})
    got = {r.i: r.d for r in out.collect()}
    for i, (text, expected) in enumerate(DATES):
        assert got[i] == expected, text


CLEAN = [("  a   b  ", "a b"), ("a\nb\n\nc", "a b c"), ("a\tb", "a b"), ("a b", "a b"),
         ("", ""), (None, ""), (" x　", "x"), ("a\x1cb", "a b"), ("x", "x")]


def test_clean_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text(SPARK, F.col("t")).alias("c")).collect()}
    for i, (text, expected) in enumerate(CLEAN):
        assert got[i] == expected, repr(text)


def test_listing_type_and_flags(spark):
    from rentgrid.functions import patterns as P
    rows = [(0, "cozy basement apt", "a"), (1, "shared bedroom downtown", "a"), (2, "shared bedroom downtown", "b"),
            (3, "2 bed condo", "a"), (4, "nice place", "a")]
    df = spark.createDataFrame(rows, "i int, t string, v string")
    typ = F.when(F.col("v") == "a", C.classify_listing_type(SPARK, F.col("t"), F.lit("room_private"),
                                                              P.LISTING_TYPE_RULES_A)) \
           .otherwise(C.classify_listing_type(SPARK, F.col("t"), F.lit("room_private"), P.LISTING_TYPE_RULES_B))
    got = {r.i: r.k for r in df.select("i", typ.alias("k")).collect()}
    assert got == {0: "basement_suite", 1: "room_shared", 2: "room_private", 3: "2br", 4: "room_private"}

    attrs = spark.createDataFrame([(["Unfurnished", "dogs are OK", "700ft2", "900 ft"],),
                                   (["Furnished: No", "Pets: yes", "Size: 500 sqft"],)], "a array<string>")
    cl = C.craigslist_attr_flags(SPARK, F.col("a"))
    kj = C.kijiji_attr_flags(SPARK, F.col("a"))
    r = attrs.select(cl["furnished"].alias("cf"), cl["pets_allowed"].alias("cp"), cl["square_feet"].alias("cs"),
                     kj["furnished"].alias("kf"), kj["pets_allowed"].alias("kp"), kj["square_feet"].alias("ks")).collect()
    assert (r[0].cf, r[0].cp, r[0].cs) == (True, True, 900)      # 'unfurnished' still counts
    assert (r[1].kf, r[1].kp, r[1].ks) == (True, True, 500)      # 'furnished: no' still counts


def test_enrich_merge_rules(spark):
    from rentgrid.operators.enrich import enrich
    from rentgrid.schema import LISTING_SCHEMA
    base = {f.name: None for f in LISTING_SCHEMA.fields}
    rows = [
        dict(base, id="a", source="craigslist", title="Room", description="No pets. Pet friendly. 3 bed. Unfurnished.",
             location="", pets_allowed=True, num_bedrooms=2),
        dict(base, id="b", source="kijiji", title="Room", description="Furnished bedroom. Laundry in unit. Dogs ok.",
             location="Kits"),
        dict(base, id="c", source="facebook", title="Room", description="No pets, near UBC", location="",
             pets_allowed=None),
    ]
    df = spark.createDataFrame(rows, LISTING_SCHEMA)
    got = {r.id: r for r in enrich(df).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert a.pets_allowed is True and a.num_bedrooms == 2          # captured value wins
    assert a.furnished is False and a.furniture_level == "unfurnished"
    assert b.pets_allowed is True and b.furnished is True and b.laundry_in_unit is True
    assert b.neighbourhood == "Kitsilano"
    assert c.pets_allowed is None and c.neighbourhood == "UBC"     # posts: neighbourhood only


def _state_rows(spark, rows):
    from rentgrid.operators.state import STATE_COLUMNS
    from rentgrid.schema import STATE_SCHEMA
    from pyspark.sql import types as T
    schema = T.StructType(STATE_SCHEMA.fields + [T.StructField("seq", T.LongType())])
    full = [{**{c: None for c in STATE_COLUMNS}, **r} for r in rows]
    return spark.createDataFrame(full, schema)


def test_upsert_first_and_last_writer(spark):
    from rentgrid.operators.state import upsert
    batch1 = _state_rows(spark, [dict(id="x", title="first", price=1000, description="d1", seq=1),
                                 dict(id="x", title="second", price=None, description="d2", seq=2),
                                 dict(id="y", title="only", price=500, seq=3)])
    s1 = {r.id: r for r in upsert(None, batch1, "seq").collect()}
    assert s1["x"].title == "first"            # first writer
    assert s1["x"].price is None               # last writer, even NULL
    assert s1["x"].description == "d2"
    batch2 = _state_rows(spark, [dict(id="x", title="third", price=1100, seq=0)])
    s2 = {r.id: r for r in upsert(upsert(None, batch1, "seq"), batch2, "seq").collect()}
    assert s2["x"].title == "first" and s2["x"].price == 1100 and s2["y"].price == 500


def test_price_log_a_b_a(spark):
    from rentgrid.operators.state import first_seen_prices, price_log_increment
    obs = spark.createDataFrame([("x", 100, dt.datetime(2026, 1, 1)), ("x", 200, dt.datetime(2026, 1, 2)),
                                 ("x", 100, dt.datetime(2026, 1, 3))], "listing_id string, price int, observed_at timestamp")
    assert first_seen_prices(obs).count() == 2
    hist = first_seen_prices(obs.limit(1))
    inc = price_log_increment(hist, obs).collect()
    assert [(r.listing_id, r.price) for r in inc] == [("x", 200)]


def test_exact_quantiles(spark):
    from rentgrid.operators.stats import price_summary
    df = spark.createDataFrame([(p,) for p in [1, 2, 3, 4, 4, 0, None]], "price int")
    r = price_summary(df).collect()[0]
    assert (r.median_price, r.p25_price, r.p75_price) == (3, 2, 4)
    assert (r.listings, r.priced, r.min_price, r.max_price) == (7, 5, 1, 4)


def test_snapshot_merge_and_post_dedup(spark):
    from rentgrid.operators.dedup import dedup_posts, merge_snapshots
    rows = [("a", "u1", 0, 1, "old"), ("a", "u1", 1, 5, "new"), (None, "u2", 0, 2, "x"), (None, None, 0, 3, "e1"),
            (None, None, 1, 4, "e2")]
    df = spark.createDataFrame(rows, "id string, url string, snapshot_no int, listing_key long, title string")
    got = {(r.id, r.url, r.title) for r in merge_snapshots(df).collect()}
    assert got == {(None, None, "e2"), (None, "u2", "x"), ("a", "u1", "new")}
    posts = spark.createDataFrame([(1, "A" * 100 + "x"), (2, "A" * 100 + "y"), (3, ""), (4, "B")],
                                  "seq long, text string")
    kept = sorted(r.seq for r in dedup_posts(posts, "text", "seq", 100).collect())
    assert kept == [1, 4]


def test_store_rerun_is_idempotent(spark, tmp_path):
    from rentgrid.operators.state import ListingStore
    store = ListingStore(spark, str(tmp_path / "store"))
    batch = _state_rows(spark, [dict(id="x", source="kijiji", title="t", price=900, seq=1)])
    runs = spark.createDataFrame([("kijiji", 1, AS_OF, AS_OF)], "source string, id long, started_at timestamp, finished_at timestamp")
    for _ in range(2):
        store.apply_batch(0, batch, runs, "seq", F.lit(AS_OF))
    assert store.listings().count() == 1
    assert store.log("price_history").count() == 1
    assert store.log("scrape_runs").count() == 1
    batch2 = _state_rows(spark, [dict(id="x", source="kijiji", title="t2", price=950, seq=1)])
    store.apply_batch(1, batch2, runs, "seq", F.lit(AS_OF))
    assert store.listings().collect()[0].title == "t"
    assert store.log("price_history").count() == 2
