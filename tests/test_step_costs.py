"""Steps of the listing queries do no work that grows without need."""

import datetime
import os
import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from rentgrid.functions.dialect import SPARK
from rentgrid.functions.extract import extract_price
from rentgrid.operators import matching, query
from rentgrid.operators.enrich import enrich
from rentgrid.operators.graph import Steps, shared_folder
from rentgrid.plans import catalog
from rentgrid.schema import LISTING_FIELDS
from rentgrid.sources import selectors, snapshots


def test_what_a_pattern_did_not_find_is_not_cast(spark):
    row = spark.range(1).select(*[F.lit(None).cast("array<string>" if t == "array<string>" else t).alias(n) for n, t in LISTING_FIELDS])
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = enrich(row)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    casts = re.findall(r"(THEN )?try_cast\((\w+)", plan)
    assert casts
    # a failing cast raises and catches an exception for each row
    assert not [c for c in casts if not c[0] and c[1] in ("regexp_extract", "replace", "CASE")]


def test_found_numbers_are_as_cast(spark):
    texts = ["", "12", "007", "99999999999", "99999999999999999999", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(SPARK.found_int(F.col("t")).alias("i"), SPARK.found_bigint(F.col("t")).alias("b"),
                    F.col("t").try_cast("int").alias("ci"), F.col("t").try_cast("bigint").alias("cb")).collect()
    assert [(r.i, r.b) for r in got] == [(r.ci, r.cb) for r in got]
    texts = ["", "x", "1.5", " 2 ", "1e3", "NaN", "inf", "-Infinity", "infinit", "4d", "--", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(SPARK.try_double(F.col("t")).cast("string").alias("d"), F.col("t").try_cast("double").cast("string").alias("c")).collect()
    assert [r.d for r in got] == [r.c for r in got]


def test_staged_price_is_the_price(spark):
    df = spark.createDataFrame([(t,) for t in ("$1,200/month", "950 / mo", "$50 or 700 per month", "$,", "", "$99999999999", None)], "t string")
    first, second = {}, {}
    price = extract_price(SPARK, F.col("t"), (first, second))
    staged = df.select("*", *[e.alias(n) for n, e in first.items()]).select("*", *[e.alias(n) for n, e in second.items()])
    assert [r[0] for r in staged.select(price).collect()] == [r[0] for r in df.select(extract_price(SPARK, F.col("t"))).collect()] == [
        1200, 950, 700, None, None, None, None]


def test_records_of_many_pages_come_in_parts():
    page = "<ul>" + "".join(f'<li class="c"><b class="t">{i}</b></li>' for i in range(40)) + "</ul>" + " " * 100_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([page, None] * 30)], ["page_id", "html"])
    parts = list(selectors.record_batches([batch], selectors.Record(("li.c",), {"t": selectors.Field(".t")}), "page_id"))
    rows = [r for part in parts for r in part.to_pylist()]
    cards = [{"page_id": p, "pos": i, "t": str(i)} for p in range(0, 60, 2) for i in range(40)]
    assert [r for r in rows if r["t"] is not None] == cards
    assert max(part.num_rows for part in parts) < len(cards) // 2


def test_matchers_split_the_classes_of_an_element_once():
    class Attrs(dict):
        reads = 0

        def get(self, *a):
            Attrs.reads += a[0] == "class"
            return super().get(*a)
    element = selectors._Element("li", [("class", "a  b"), ("data-x", None)], None, 0, 0)
    above = selectors._Element("ul", [("id", "u")], None, 0, 0)
    element.attrs, element.above = Attrs(element.attrs), above
    found = {s: selectors.matcher(s)(element) for s in (
        ".a", "li.b, p", "li.a.b", ".c, .d", "#u .a", "ul#u li", "ol li", "div .a, [data-x]", '[class*="a"] .a', "p.a")}
    assert found == {".a": True, "li.b, p": True, "li.a.b": True, ".c, .d": False, "#u .a": True, "ul#u li": True, "ol li": False,
                     "div .a, [data-x]": True, '[class*="a"] .a': False, "p.a": False}
    assert Attrs.reads == 0


def _size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_fuzzy_duplicates_leaves_its_steps_behind_no_longer(spark):
    rows = [(k, "a", 1000 + k % 40, "x", " ".join(f"w{k % 60 // (i + 1)}x{i}" for i in range(30))) for k in range(600)]
    df = spark.createDataFrame(rows, "key long, source string, price int, neighbourhood string, body string")
    folder = shared_folder(spark).removeprefix("file:")
    before = _size(folder)
    out = matching.fuzzy_duplicates(df, "key", F.col("body"), limit=20)
    # what is left is the result, not the words, entries and pairs on the way
    assert _size(folder) - before < 60_000
    assert out.count() == 600


def test_entries_carry_no_words(spark):
    rows = [(k, "x", 1000, [f"{w}" for w in range(k, k + 20)]) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, area string, price int, w array<string>").select(
        "key", "area", "price", F.transform("w", lambda w: F.xxhash64(w)).alias("words"))
    entries = matching._entries(matching._items(df), 50, 4, 5, 5, 4)
    assert "words" not in entries.columns and {"item", "own", "key", "price", "n"} == set(entries.columns)


def test_filters_of_listings_compute_their_columns_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        out = catalog.get_listings_filtered(spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # for the ranked keys and for the rows of those that are kept, not again in each filter
    assert plan.count("(?:per|a)") == 2
    rows = out.collect()
    assert 0 < len(rows) <= 100 and all(500 <= r.price <= 2000 and r.listing_type == "room_private" for r in rows)


def test_rows_of_keys_are_the_listings(spark):
    rows = [(k % 40, "a", 600 + 10 * k, "studio", datetime.datetime(2026, 1, 1 + k % 28), f"i{k}") for k in range(80)]
    df = spark.createDataFrame(rows, "k long, source string, price int, listing_type string, extracted_at timestamp, id string")
    how = dict(listing_type="studio", min_price=700, max_price=1200, limit=9, key=["k"])
    again = query.get_listings(df, **how, rows_of=lambda keys: df.join(keys, "k", "left_semi"))
    assert again.collect() == query.get_listings(df, **how).collect() and again.count() >= 9


def test_hot_groups_of_phrases_make_few_entries(spark):
    """Texts of the same few phrases: dealing a hot group again by one common
    word more at a time makes over a hundred entries of each."""
    rng = random.Random(3)
    slots = [[[f"s{s}p{p}w{w}" for w in range(4)] + ["the", "room"] for p in range(8)] for s in range(8)]
    rows = [(k, "hot", 900 + k % 5, [w for s in slots for w in rng.choice(s)]) for k in range(2000)]
    df = spark.createDataFrame(rows, "key long, area string, price int, w array<string>").select(
        "key", "area", "price", F.array_sort(F.array_distinct(F.transform("w", lambda w: F.xxhash64(w)))).alias("words"))
    items = matching._items(df)
    entries = matching._entries(items, 50, 4, 5, 4, 4)
    assert entries.count() < 60 * items.count()
    assert entries.groupBy("key").count().agg(F.max("count")).first()[0] <= 60


def test_steps_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}
    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    old = spark.conf.get(setting, None)
    steps = Steps(spark)
    kept = steps.keep(spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count())
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(.2)
    assert not files() - before
    assert kept.count() == 997 and spark.conf.get(setting, None) == old
    steps.drop(kept)


def test_listing_json_reads_its_text_once_for_all_fields(spark, monkeypatch):
    odd = ['a "quoted" \\ back\nslash', "é😀  /", "", None, "null", '["x"]', "\t"]
    images = [["u,1", '"'], [], None, ["é", ""]]
    rows = [(k, odd[k % 7], odd[(k + 3) % 7], k % 5 * 100 if k % 5 else None, (k - 9) / 7 * 10.0 ** (k - 9) if k % 4 else None,
             datetime.datetime(2026, 1, 1, 0, 0, k, k * 1111) if k % 3 else None, images[k % 4]) for k in range(20)]
    df = spark.createDataFrame(rows, "listing_key long, source string, title string, price int, latitude double, posted_date timestamp, image_urls array<string>")
    df = df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in LISTING_FIELDS if n not in df.columns])
    monkeypatch.setattr(catalog, "enriched", lambda spark, sf_dir: df)
    out = catalog.listing_json(spark, "")
    assert "get_json_object" not in out._jdf.queryExecution().analyzed().toString()
    text = snapshots.to_json_lines(df, keep=["listing_key"])
    plain = text.select("listing_key", F.size(F.json_object_keys("json")).alias("n_keys"),
                        *[F.get_json_object("json", f"$.{c}").alias(c) for c in catalog._JSON_FIELDS])
    assert out.schema == plain.schema and sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
