import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rentgrid.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="rentgrid-tests", shuffle_partitions=4)
    yield s
    s.stop()


def parse_rows(spark, texts, title="", location=""):
    """Parse each text as a description; returns list of dicts of parsed columns."""
    from pyspark.sql import functions as F
    from rentgrid.operators.enrich import parse_text
    rows = [(i, title, t, location) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, title string, description string, location string")
    out = parse_text(df, "title", "description", "location", keep=["i"]).orderBy("i").collect()
    return [r.asDict() for r in out]
