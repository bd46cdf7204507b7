"""What the upserts and the maintained view compute, and how often."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentgrid.operators import state
from rentgrid.schema import as_listings

AT = dt.datetime(2026, 11, 1)
ROWS = [("a", 1, "room t1", 100), ("a", 1, "room t1", 100), ("a", 3, "suite t3", None), ("a", 2, "t2", 200), (None, 5, "n5", 5),
        (None, 4, "n4", 4), ("b", 1, "x", 1), ("b", 9, "y", 2), ("c", 8, "z", 0)]


@pytest.fixture(scope="module")
def captures(spark):
    df = spark.createDataFrame([(*r, "craigslist", AT) for r in ROWS], "id string, _seq long, title string, price int, source string, extracted_at timestamp")
    return as_listings(df, keep=["_seq"]).withColumns({"scrape_run_id": F.col("_seq"), "listing_key": F.col("_seq"), "snapshot_no": F.when(
        F.col("_seq") < 3, 0).otherwise(2)}).repartition(5)


def derive(df):
    """A first-writer and a last-writer column from the text."""
    return df.withColumns({"listing_type": F.upper("title"), "vibe": F.concat(F.lit("v "), "title")})


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*state.STATE_COLUMNS).collect()), key=str)


def test_rules_run_on_one_row_of_an_id_at_a_time(captures):
    seen = []
    got = state.first_state(captures, "_seq", lambda df: seen.append(df) or derive(df))
    assert rows_of(got) == rows_of(state.upsert(None, derive(captures), "_seq"))
    assert [df.count() for df in seen] == [4, 4]  # ids, of nine captures


def test_batches_are_derived_after_their_rows_are_found(captures):
    want = state.upsert(None, derive(captures), "_seq")
    seen = []
    spy = lambda df: seen.append(df) or derive(df)
    stored = state.upsert(None, captures.where("snapshot_no < 2"), "_seq", spy)
    got = state.upsert(stored, captures.where("snapshot_no >= 2"), "_seq", spy)
    assert rows_of(got) == rows_of(want)
    assert [df.count() for df in seen] == [2, 2, 4, 4]


def test_state_of_some_columns(captures):
    whole = state.upsert(None, captures, "_seq")
    narrow = captures.select("id", "source", "price", "snapshot_no", "_seq", state.tie().alias("_tie"))
    stored = state.upsert(None, narrow.where("snapshot_no < 2"), "_seq", columns=["source", "price"])
    got = state.upsert(stored, narrow.where("snapshot_no >= 2"), "_seq", columns=["source", "price"])
    assert got.columns == ["id", "source", "price"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.select("id", "source", "price").collect()), key=str)


def test_maintained_summary_decodes_each_capture_once(spark, captures, monkeypatch, tmp_path):
    from rentgrid.plans import market_catalog

    decoded = spark.sparkContext.accumulator(0)

    def count(source):
        decoded.add(1)
        return source

    counted = captures.withColumn("source", F.udf(count).asNondeterministic()("source"))
    monkeypatch.setattr(market_catalog, "listings", lambda spark, sf_dir: counted)
    row = market_catalog.maintained_price_summary(spark, str(tmp_path)).collect()[0]
    assert decoded.value == len(ROWS)
    assert (row.source, row.listings, row.priced, row.min_price, row.max_price) == ("craigslist", 4, 2, 2, 5)
