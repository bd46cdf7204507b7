"""Both upserts on repeated rows, equal order values and missing ids; the top-k plan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentgrid.operators import query, state
from rentgrid.schema import FIRST_WRITER_COLUMNS, LISTING_COLUMNS, as_listings

AT = dt.datetime(2026, 11, 1)


@pytest.fixture(scope="module")
def captures(spark):
    rows = [("a", 1, "t1", 100), ("a", 1, "t1", 100), ("a", 3, "t3", None), ("a", 3, "t3", None), ("a", 2, "t2", 200),
            (None, 5, "n5", 5), (None, 4, "n4", 4), (None, 5, "n5", 5), ("b", 1, "x", 1), ("b", 1, "y", 2), ("", 1, "empty", 9)]
    df = spark.createDataFrame([(*r, "craigslist", AT) for r in rows], "id string, _seq long, title string, price int, source string, extracted_at timestamp")
    return as_listings(df, keep=["_seq"]).withColumns({"scrape_run_id": F.col("_seq"), "listing_key": F.lit(1), "snapshot_no": F.lit(0)}).repartition(5)


def rows_of(df):
    return sorted(((r.id, r.title, r.price, r.scrape_run_id) for r in df.collect()), key=str)


def test_upserts_agree_on_repeated_rows(captures):
    one = state.upsert(None, captures, "_seq")
    two = state.first_state(captures, "_seq", lambda df: df)
    got = rows_of(one)
    assert got == rows_of(two) and len(got) == 4
    pick = lambda column, first, last: first if column in FIRST_WRITER_COLUMNS else last
    ends = lambda f, l: tuple(pick(c, x, y) for c, x, y in zip(("title", "price", "scrape_run_id"), f, l))
    assert {r[0]: r[1:] for r in got if r[0] != "b"} == {
        "a": ends(("t1", 100, 1), ("t3", None, 3)), None: ends(("n4", 4, 4), ("n5", 5, 5)), "": ("empty", 9, 1)}
    assert rows_of(state.upsert(None, captures.union(captures).repartition(3), "_seq")) == got
    stored = state.upsert(None, captures.where("_seq < 3"), "_seq")
    assert rows_of(state.upsert(stored, captures.where("_seq >= 3"), "_seq")) == got


def test_top_k_ranks_keys_alone(spark, captures):
    many = spark.range(5000).select(F.col("id").alias("listing_key"), F.concat(F.lit("l"), "id").alias("id"), (F.col("id") % 700).cast("int").alias("price"),
                                    F.lit("kijiji").alias("source"), F.timestamp_seconds(F.col("id") % 50).alias("extracted_at"))
    df = as_listings(many, keep=["listing_key"])
    got = query.get_listings(df, source="kijiji", min_price=100, limit=7, key=["listing_key"])
    want = query.get_listings(df, source="kijiji", min_price=100, limit=7)
    assert [r.id for r in got.collect()] == [r.id for r in want.collect()] and set(LISTING_COLUMNS) <= set(got.columns)
    plan = got.withColumn("more", F.upper("id")).select("more", "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
