"""Written dates against the standard free-form reader of Python."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from rentgrid.functions import capture as C
from rentgrid.functions.dialect import DUCK, SPARK
from rentgrid.functions.stages import apply_stages, stages_sql

AS_OF = dt.datetime(2026, 12, 31, 12, 0, 0)
NAMED = ["Nov 5", "Thu Nov 5", "Tuesday", "November 3rd, 2026", "5 Nov", "5th of November", "Sept 1 2026", "sep 30", "Feb 30", "february 29", "Feb", "June",
         "November 2026", "2026 Nov 5", "nov. 5, 2026 at 3:45 pm", "Nov 5 10:30", "10:15", "10:15:30", "3 pm", "12am", "12:05 AM", "25:00", "10:61",
         "11/5", "11/02/26", "11/02/75", "11/02/77", "11-02-2026", "2.11.2026", "2026/11/2", "2026-11", "5-Nov-2026", "Mon", "thu", "Thursday 5pm",
         "Fri., 9pm", "Sunday Feb", "on Monday at 9:00", "1 Jan 99", "Nov 31", "Dec 31", "sat, 2 may 2026"]
NO_DATE = ["whenever", "soon", "call me", "room 5 available", "Nov 5 or Nov 6", "Nov Dec", "MM 5"]


def expected(text):
    from dateutil import parser
    try:
        return parser.parse(text.lower(), default=AS_OF.replace(hour=0))
    except (ValueError, OverflowError):
        return None


@pytest.fixture(scope="module")
def read(spark):
    def run(texts, as_of=AS_OF):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        stages = C.relative_date_stages(SPARK, F.col("t"), F.lit(as_of), "_rd")
        got = {r.i: r.d for r in apply_stages(df, stages, {"i": F.col("i"), "d": F.col("_rd")}).collect()}
        return [got[i] for i in range(len(texts))]
    return run


def test_written_dates(read):
    got = read(NAMED)
    assert {t: g for t, g in zip(NAMED, got)} == {t: expected(t) for t in NAMED}


def test_every_combination(read):
    """Weekday, date and time in any company."""
    dates = ["", "Nov 5", "5th Nov", "November 5, 2026", "Feb", "11/5", "2026-02"]
    texts = [" ".join(p for p in (w, d, t) if p) for w, d, t in itertools.product(["", "Tue", "Thursday,"], dates, ["", "10:30", "9 pm"])]
    texts = [t for t in texts if t]
    assert dict(zip(texts, read(texts))) == {t: expected(t) for t in texts}


def test_no_dates(read):
    assert read(NO_DATE) == [None] * len(NO_DATE)


def test_weekday_counts_from_today(read):
    assert read(["Tuesday", "Wednesday"], dt.datetime(2026, 12, 1, 9)) == [dt.datetime(2026, 12, 1), dt.datetime(2026, 12, 2)]


def test_iso_compact(spark):
    texts = ["20261120T101500", "20261120T1015", "20261120T10", "20261131T101500", "20261120 101500x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.d for r in df.select("i", C.iso_timestamp(SPARK, F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [dt.datetime(2026, 11, 20, 10, 15), dt.datetime(2026, 11, 20, 10, 15), None, None, None]


def test_both_engines_read_alike(read):
    import duckdb
    texts = NAMED + NO_DATE
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT unnest(range(len($t))) AS i, unnest($t) AS t", {"t": texts})
    sql = stages_sql("x", C.relative_date_stages(DUCK, "t", DUCK.ts_lit("2026-12-31 12:00:00"), "_rd"), {"i": "i", "d": "_rd"})
    assert [r[1] for r in con.execute(f"SELECT * FROM ({sql}) ORDER BY i").fetchall()] == read(texts)
