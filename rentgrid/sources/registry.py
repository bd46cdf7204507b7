"""Source plug-ins (J1) and source selection.

A source is a function ``(captured DataFrame, as_of) -> listings DataFrame``;
``as_of`` is "now" for the relative dates of the captures.
``select_sources`` takes the comma-separated list a job is configured
with: blanks are stripped, empty names dropped, an unknown name is
reported and contributes no rows, and the known ones are kept by a
filter that Spark pushes into the scan of stored captures.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import patterns as P
from rentgrid.operators.dedup import union_sources
from rentgrid.operators.enrich import enrich
from rentgrid.sources import captures

log = logging.getLogger(__name__)

#: ``(captured, as_of) -> listings`` by source name; the built-in sources are in it.
_REGISTRY: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def register_source(name: str, fn: Callable[[DataFrame, str], DataFrame]) -> None:
    _REGISTRY[name] = fn


def source_names(spec: str, warn: bool = True) -> list[str]:
    """Parse a comma list; unknown names are reported and skipped."""
    names = [s.strip() for s in spec.split(",") if s.strip()]
    known = set(P.SOURCES) | set(_REGISTRY)
    for n in names:
        if n not in known and warn:
            log.warning("Unknown source: %s", n)
    return [n for n in names if n in known]


def select_sources(df: DataFrame, spec: str) -> DataFrame:
    """Rows of the configured sources only (an empty selection gives no rows)."""
    return df.filter(F.col("source").isin(source_names(spec)))


def decode_registered(df: DataFrame, name: str, as_of: str) -> DataFrame:
    """Run a registered plug-in on the rows of its source."""
    return _REGISTRY[name](df.filter(F.col("source") == name), as_of)


for _name in P.SOURCES:
    register_source(_name, captures.decode)


def listings_of(df: DataFrame, spec: str, as_of: str) -> DataFrame:
    """Enriched listings of the configured sources, each by its own decoder."""
    return enrich(union_sources([decode_registered(df, n, as_of) for n in source_names(spec)]))
