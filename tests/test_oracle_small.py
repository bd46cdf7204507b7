"""Registered queries against their DuckDB oracle on sf0.001 (the same kind
of check the round driver makes at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from rentgrid.session import TABLES

SELECTED = [
    "neighbourhood_price_stats", "enrich_listings", "enrich_documents", "decode_jsonld_pages",
    "decode_model_answers", "get_listings_filtered", "first_per_source", "price_summary_by_source",
    "merge_snapshots", "upsert_state", "price_log_increment", "run_log", "dedup_posts", "split_dumps",
    "price_changes", "rent_percentile", "attach_details", "select_sources", "listing_summary",
]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(repr(_norm(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SELECTED)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    ocols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, df.collect()) == _rows(ocols, cur.fetchall())
