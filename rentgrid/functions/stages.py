"""Staged projections.

A value that several rules read (a cleaned description, a lower-cased text,
a relative-date offset) is computed once as a column in an earlier
projection and referenced by name afterwards.  Catalyst keeps such a
projection separate (it does not inline a non-trivial expression that is
referenced more than once), so each value is evaluated once per row, and
the generated code stays small.

Intermediate stages only add new columns; the final stage is an explicit
projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_stages(df: DataFrame, stages: list[dict], final: dict) -> DataFrame:
    for stage in stages:
        df = df.select("*", *[e.alias(n) for n, e in stage.items()])
    return df.select(*[e.alias(n) for n, e in final.items()])


def stages_sql(relation: str, stages: list[dict], final: dict) -> str:
    sql = f"SELECT * FROM {relation}"
    for i, stage in enumerate(stages):
        cols = ", ".join(f"{e} AS {n}" for n, e in stage.items())
        sql = f"SELECT *, {cols} FROM ({sql}) s{i}"
    body = ",\n  ".join(f"{e} AS {n}" for n, e in final.items())
    return f"SELECT\n  {body}\nFROM ({sql}) s_final"


def keep(names) -> dict:
    """Final-stage entries that pass columns through unchanged (Spark)."""
    return {n: F.col(n) for n in names}


_CACHE: dict = {}


def cached(key: tuple, build):
    """Build Spark expressions once per SparkContext and key.

    The rule set is a few thousand expression nodes; constructing them
    through the Python-JVM bridge costs seconds, while the unresolved
    expressions themselves can be reused by any number of plans.
    """
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    full = (id(sc),) + key
    if full not in _CACHE:
        _CACHE[full] = build()
    return _CACHE[full]
