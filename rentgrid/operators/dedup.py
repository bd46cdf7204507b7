"""Set operations and deduplication.

Keep-first / keep-last per key is written as ``groupBy(key)`` with
``min_by`` / ``max_by`` over a struct of the row, ordered by a struct of
the position columns.  Both aggregates combine partially before the
shuffle, so a key that holds a third of all rows (e.g. the empty key) is
reduced to one row per map task instead of being sorted in one task, as a
``row_number`` window would do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union all of per-source listing frames by column name; a source with
    no rows adds nothing, missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_by(df: DataFrame, key: F.Column, order: list[str], last: bool) -> DataFrame:
    """One row per ``key``: the row with the greatest (``last``) or least
    ``order`` tuple."""
    cols = df.columns
    row = F.struct(*[F.col(c) for c in cols])
    pos = F.struct(*[F.col(c) for c in order])
    pick = F.max_by(row, pos) if last else F.min_by(row, pos)
    return df.groupBy(key.alias("_key")).agg(pick.alias("_row")).select("_row.*")


def merge_snapshots(df: DataFrame, file_col: str = "snapshot_no", pos_col: str = "listing_key") -> DataFrame:
    """Merge listing snapshots: key is ``id``, else ``url``, else ''; the
    last file wins and within a file the later row wins."""
    key = F.coalesce(F.col("id"), F.col("url"), F.lit(""))
    return keep_by(df, key, [file_col, pos_col], last=True)


def latest_snapshot(df: DataFrame, file_col: str = "snapshot_no") -> DataFrame:
    """Rows of the last snapshot only, for frames in memory of a query; stored
    snapshots are found by their folders (``snapshots.latest``)."""
    last = df.agg(F.max(file_col).alias("_last"))
    return df.join(last, F.col(file_col) == F.col("_last"), "left_semi")


def dedup_posts(df: DataFrame, text_col: str, seq_col: str, prefix_chars: int) -> DataFrame:
    """Posts de-duplicated on their first ``prefix_chars`` characters, first
    by ``seq_col`` wins; posts with empty text are dropped.  Whole texts are
    kept in the output; only the key is a prefix."""
    key = F.substring(F.col(text_col), 1, prefix_chars)
    non_empty = df.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    return keep_by(non_empty, key, [seq_col], last=False)


def first_posts_of_key(df: DataFrame, text_col: str, seq_col: str, prefix_chars: int) -> DataFrame:
    """:func:`dedup_posts` without the text column: only the key prefix and the
    other columns are moved, never whole texts."""
    key = F.substring(F.col(text_col), 1, prefix_chars)
    non_empty = df.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    rest = [c for c in df.columns if c != text_col]
    return keep_by(non_empty.select(*rest, key.alias("_prefix")), F.col("_prefix"), [seq_col], last=False).select(*rest)
