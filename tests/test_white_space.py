"""White space is cleaned as Python does it, without searching whole texts for it."""

import re

from pyspark.sql import functions as F

from rentgrid.functions.dialect import PY_SPACES, SPARK
from rentgrid.functions.extract import clean_text
from rentgrid.sources import posts
from rentgrid.sources.captures import decode
from rentgrid.sources.fixture import AS_OF, fixture_columns

TEXTS = [None, "", " ", "\n", "a", " a ", "a  b", "a\n", "\na b\n\n", "é", " é  é ", "a　", "\x1ca\x1fb\x85", "a \tb", "​ a​ ",
         "﻿ a", "a\xa0b", "\xa0", "a b c", "x" * 50 + "  ", "   z  "] + [f"{c}a{c}b {c}c{c}{c}" for c in PY_SPACES]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_and_collapse_as_python(spark):
    assert PY_SPACES == "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, x string")
    got = df.select("i", SPARK.strip(F.col("x")).alias("s"), posts.strip(F.col("x")).alias("p"), clean_text(SPARK, F.col("x")).alias("c")).collect()
    for r in got:
        t = TEXTS[r.i]
        assert r.s == r.p == (None if t is None else t.strip()), repr(t)
        assert r.c == re.sub(r"[\s\xa0]+", " ", t or "").strip(), repr(t)


def test_strip_runs_no_pattern(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("x"))
    assert "regexp" not in plan_of(df.select(SPARK.strip(F.col("x")), posts.strip(F.col("x"))))


def test_boilerplate_is_cut_once_a_capture(spark):
    orders = spark.range(5).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.to_date(F.lit("2026-01-01")).alias("o_orderdate"))
    raw = orders.repartition(2).select(*[e.alias(n) for n, e in fixture_columns(SPARK).items()])
    assert plan_of(decode(raw, AS_OF).select("description")).count("QR Code Link.*") == 1
