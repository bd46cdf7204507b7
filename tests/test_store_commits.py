"""Two writers on one store, compaction of its logs, declared constraints."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rentgrid.operators import constraints, state
from rentgrid.schema import STATE_COLUMNS_BY_NAME

DAY = dt.datetime(2026, 1, 1)


def rows_of(spark, rows):
    kind = ", ".join(f"{n} {t}" for n, t in STATE_COLUMNS_BY_NAME.items())
    made = [tuple(({"source": "kijiji", "title": "t", "extracted_at": DAY} | r).get(n) for n in STATE_COLUMNS_BY_NAME) for r in rows]
    return spark.createDataFrame(made, kind).withColumn("seq", F.lit(1))


@pytest.fixture
def runs(spark):
    return spark.createDataFrame([("kijiji", 1, DAY, DAY)], "source string, id long, started_at timestamp, finished_at timestamp")


def apply(store, n, batch, runs):
    store.apply_batch(n, batch, runs, "seq", F.lit(DAY + dt.timedelta(days=n)))


def prices(store):
    return sorted((r.listing_id, r.price, r.batch) for r in store.log("price_history").collect())


def test_the_later_of_two_writers_starts_again(spark, tmp_path, runs, monkeypatch):
    one, two = (state.ListingStore(spark, str(tmp_path), buckets=2) for _ in range(2))
    apply(one, 0, rows_of(spark, [dict(id="a", price=1)]), runs)
    # batch 1 is stored by another writer after batch 2 was made from version 0
    write, made = two._write, []

    def meanwhile(*args):
        write(*args)
        made.append(args[0])
        if len(made) == 1:
            apply(one, 1, rows_of(spark, [dict(id="a", price=2), dict(id="b", price=5)]), runs)
    monkeypatch.setattr(two, "_write", meanwhile)
    apply(two, 2, rows_of(spark, [dict(id="a", price=2), dict(id="c", price=7)]), runs)
    assert made == [2, 2]
    assert sorted((r.id, r.price) for r in two.listings().collect()) == [("a", 2), ("b", 5), ("c", 7)]
    assert prices(two) == [("a", 1, 0), ("a", 2, 1), ("b", 5, 1), ("c", 7, 2)]


def test_an_earlier_batch_after_a_later_one_is_refused(spark, tmp_path, runs):
    store = state.ListingStore(spark, str(tmp_path), buckets=2)
    apply(store, 0, rows_of(spark, [dict(id="a", price=1)]), runs)
    apply(store, 2, rows_of(spark, [dict(id="a", price=3)]), runs)
    with pytest.raises(state.ConflictingBatch):
        apply(store, 1, rows_of(spark, [dict(id="b", price=2)]), runs)
    # what the refused batch wrote is in no version and no log
    assert [r.id for r in store.listings().collect()] == ["a"] and prices(store) == [("a", 1, 0), ("a", 3, 2)]
    apply(store, 3, rows_of(spark, [dict(id="b", price=2)]), runs)
    assert prices(store)[-1] == ("b", 2, 3)


def test_compaction_keeps_the_log_and_bounds_its_folders(spark, tmp_path, runs):
    store = state.ListingStore(spark, str(tmp_path), buckets=2)
    apply(store, 0, rows_of(spark, []), runs)  # nothing in it: no price file
    most = 0
    for n in range(1, 7):
        apply(store, n, rows_of(spark, [dict(id="a", price=n), dict(id=f"i{n}", price=9)]), runs)
        before = prices(store)
        for table in ("price_history", "scrape_runs"):
            store.compact(table)
        assert prices(store) == before and store.log("scrape_runs").count() == n + 1
        most = max(most, sum("=" in f for f in os.listdir(tmp_path / "price_history")))
    assert len(before) == 12 and most <= 6
    again = prices(store)
    apply(store, 6, rows_of(spark, [dict(id="a", price=6), dict(id="i6", price=9)]), runs)  # a retry
    assert prices(store) == again
    with pytest.raises(ValueError, match="compacted"):
        apply(store, 2, rows_of(spark, [dict(id="a", price=2)]), runs)


def test_rows_that_break_a_constraint_are_kept_apart(spark, tmp_path, runs):
    store = state.ListingStore(spark, str(tmp_path), buckets=2, enforce=True)
    rows = [dict(id="a", price=1, scrape_run_id=1), dict(id=None, price=2), dict(id="x" * 65, vibe="v" * 31, source=None),
            dict(id="b", extracted_at=None), dict(id="c", scrape_run_id=8), dict(id="d", vibe="é" * 30, scrape_run_id=None)]
    for _ in range(2):
        apply(store, 0, rows_of(spark, rows), runs)
    assert sorted(r.id for r in store.listings().collect()) == ["a", "d"]
    kept = spark.read.parquet(str(tmp_path / "quarantine" / "batch=0")).collect()
    assert sorted("; ".join(r.broken) for r in kept) == [
        "extracted_at: null", "id: null", "scrape_run_id: not in scrape_runs", "source: null; id: over 64; vibe: over 30"]


def test_checks_on_odd_frames(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "listing_id string, price int")
    parents = spark.createDataFrame([("b",), ("b",), (None,)], "id string")
    got = constraints.checked(df, constraints.PRICE_HISTORY, {"listings": parents}).collect()
    assert sorted("; ".join(r.broken) for r in got) == [
        "observed_at: null", "observed_at: null; listing_id: not in listings", "observed_at: null; listing_id: not in listings"]
    assert constraints.accepted(constraints.checked(df, constraints.Rules())).count() == 3
    assert constraints.checked(df.limit(0), constraints.LISTINGS).count() == 0
