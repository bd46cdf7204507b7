"""Keyed state: listing upsert, price log, run log, integrity audits.

Upsert semantics per listing ``id``: on a conflict the 18 first-writer
columns keep the first stored value and every other column takes the
newest value, even when it is NULL.  Rows of one batch apply in order, so
duplicates inside a batch follow the same rule.  Spark form: union the
stored state (ordered before any batch row) with the batch, then
``groupBy(id)`` with ``min_by`` for first-writer and ``max_by`` for
last-writer columns.  Both aggregates combine partially before the shuffle,
so a listing seen in every batch does not pile up in one task.

Price log: a ``(listing, price)`` pair is logged once, when first seen (a
price that goes A -> B -> A logs two rows).  Incremental form: de-duplicate
the batch on the pair and anti-join it against the stored log.

``ListingStore`` keeps each table as versioned, bucketed Parquet folders under
one root (on a cluster: shared storage).  A batch writes new versions of the
buckets that it touches and never overwrites what it reads, so a lost executor
or a failed job leaves the previous state intact and a rerun of the same batch
gives the same state.
"""

from __future__ import annotations

import functools
import os
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.operators import constraints
from rentgrid.schema import FIRST_WRITER_COLUMNS, LAST_WRITER_COLUMNS, STATE_FIELDS, STATE_SCHEMA, as_listings

STATE_COLUMNS = [n for n, _ in STATE_FIELDS]


def upsert(state: DataFrame | None, batch: DataFrame, order: str | list[str], derive=None, columns: list[str] | None = None) -> DataFrame:
    """New listing state from the stored ``state`` and an ordered ``batch``.

    ``batch`` carries the state columns and the ``order`` columns, by which
    its rows apply.  Stored rows count as older than any batch row; a stored
    table from before a column was added has NULL there.

    ``derive`` (a narrow frame function) adds the derived columns to the batch:
    see :func:`first_state`.  With ``columns`` the state is of the id and those
    alone.  A batch may bring :func:`tie` as ``_tie``, in place of its columns.
    """
    order = [order] if isinstance(order, str) else order
    fields = STATE_FIELDS if columns is None else [f for f in STATE_FIELDS if f[0] == "id" or f[0] in columns]
    names = [n for n, _ in fields]
    if derive:
        batch, order = _one_row_each(batch, order, derive), []
    last_resort = F.col("_tie") if "_tie" in batch.columns else tie()
    rows = batch.withColumn("_seq", F.struct(F.lit(1).alias("new"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                                             last_resort.alias("tie")))
    rows = rows.select(*names, "_seq")
    if state is not None:
        kind = rows.schema["_seq"].dataType
        stored = F.struct(F.lit(0).alias("new"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:]])
        rows = as_listings(state, fields).withColumn("_seq", stored).unionByName(rows)
    elif derive:
        return rows.select(*names)
    # one aggregate per rule: the first row's first-writer columns and the
    # newest row's last-writer columns (NULLs included), as two structs
    first, last = ([c for c in group if c in names] for group in (FIRST_WRITER_COLUMNS, LAST_WRITER_COLUMNS))
    rules = [f(F.struct(*group), "_seq").alias(name) for f, group, name in (
        (F.min_by, first, "_first"), (F.max_by, last, "_last")) if group]
    out = rows.groupBy("id").agg(*rules)
    cols = {c: F.col(f"_first.{c}") for c in first}
    cols.update({c: F.col(f"_last.{c}") for c in last})
    return out.select(F.col("id"), *[cols[c].alias(c) for c in names if c != "id"])


def first_state(captures: DataFrame, seq: str, derive) -> DataFrame:
    """The state after ordered captures, as :func:`upsert` without a stored
    state gives it, with the derived columns left to the rows that need them.

    ``derive`` (a narrow frame function that keeps other columns) adds the
    derived columns.  Only the first and the last row of an id give columns:
    they are found first, in one aggregate, and of each the rules run that
    its columns need.  Where several rows of an id have the same seq, the order
    of :func:`tie` decides, as in ``upsert``.  Rows without an id are one listing.
    """
    return upsert(None, captures, seq, derive)


def _one_row_each(batch: DataFrame, order: list[str], derive) -> DataFrame:
    """One row for each id of the batch, as its ordered rows leave it: derived
    first-writer columns of the first row, derived others of the last."""
    carried = [c for c in STATE_COLUMNS if c != "id"]
    row, seq = F.struct("id", *carried), F.struct(*order, tie())
    ends = batch.groupBy("id").agg(F.min_by(row, seq).alias("_first"), F.max_by(row, seq).alias("_last")).drop("id")
    # ``derive`` sees the columns of one end; the rest goes around it under other names
    run = lambda end: F.col(f"{end}.scrape_run_id").alias("scrape_run_id")
    columns = [c for c in carried if c != "scrape_run_id"]
    opened = lambda df, end, *around: df.select("_%s.id" % end, *[f"_{end}.{c}" for c in columns], run(f"_{end}"), *around)
    first = derive(opened(ends, "first", "_last"))
    kept = first.select("_last", F.struct(*FIRST_WRITER_COLUMNS).alias("_kept"))
    last = derive(opened(kept, "last", "_kept"))
    return last.select("id", "_kept.*", *LAST_WRITER_COLUMNS).select(*STATE_COLUMNS)


def tie() -> F.Column:
    """Orders rows of one id and order value by what was captured, so that the
    outcome does not depend on where the rows lie."""
    return F.xxhash64("source", "url", "title", "price", "location", "description", "extracted_at").alias("tie")


def price_observations(batch: DataFrame, observed_at: F.Column) -> DataFrame:
    """(listing_id, price, observed_at) for rows with a truthy price."""
    return (batch.filter(F.col("price").isNotNull() & (F.col("price") != 0))
                 .select(F.col("id").alias("listing_id"), F.col("price").cast("int").alias("price"),
                         observed_at.alias("observed_at")))


def first_seen_prices(observations: DataFrame) -> DataFrame:
    """The whole price log from all observations: each pair once, at its
    first observation."""
    return observations.groupBy("listing_id", "price").agg(F.min("observed_at").alias("observed_at"))


def price_log_increment(history: DataFrame | None, observations: DataFrame) -> DataFrame:
    """Rows to append to the price log for one batch: pairs of the batch
    (first observation each) that the log does not hold yet."""
    new = first_seen_prices(observations)
    if history is None:
        return new
    return new.join(history.select("listing_id", "price"), ["listing_id", "price"], "left_anti")


def run_log(batch: DataFrame, run_ids: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One run row per source of a batch, with its listing count and state.

    ``run_ids``: (keys, id, started_at, finished_at) for the sources that ran,
    and ``error`` if any failed.  A run is ``failed`` when it has an error (its
    listings were not stored: count 0), ``running`` until it has finished, and
    ``completed`` then; one that found nothing still gets a row.
    """
    keys = keys or ["source"]
    counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("listings_found"))
    error = F.col("error") if "error" in run_ids.columns else F.lit(None)
    status = F.when(error.isNotNull(), "failed").when(F.col("finished_at").isNull(), "running").otherwise("completed")
    found = F.when(error.isNotNull(), F.lit(0)).otherwise(F.coalesce("listings_found", F.lit(0)))
    return (run_ids.join(counts, keys, "left")
                   .select("id", "started_at", "finished_at", "source",
                           found.cast("bigint").alias("listings_found"), status.alias("status")))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Referential-integrity audit: child rows whose key has no parent (expect none)."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


# --------------------------------------------------------------------------
class ConflictingBatch(RuntimeError):
    """Another writer stored a batch on the version that this one was made from."""


class ListingStore:
    """Tables under one root (shared storage on a cluster):

    * ``listings/v=N/bucket=B``: the state of the ids of bucket B after batch
      N; only buckets that the batch touches are written, and
      ``manifest/v=N`` says which version holds each bucket;
    * ``price_history/batch=N/bucket=B`` and ``scrape_runs/batch=N``:
      a batch is compared with the touched buckets only; ``compact`` folds
      older batches into ``compact=N``;
    * ``quarantine/batch=N``: rows that break a declared constraint, with the
      reasons, where the store was made with ``enforce``;
    * ``claims/after=N``: the batch that was stored on top of version N.

    A batch counts once its manifest is complete.  Applying batch N again
    rewrites only its own folders from the versions before N, so a retried or
    repeated batch leaves the same tables.  Of two writers on one version, the
    first to claim it goes on; the other finds the claim and starts again from
    the new version (``ConflictingBatch`` if that one is later than its own).
    A claim is a file made exclusively, which is atomic on file systems such as
    HDFS; a writer that dies between making and filling it leaves an empty claim,
    which nobody owns and which is to be removed by hand.  ``buckets`` is fixed for a store; it should keep a bucket at some
    hundred MB.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, enforce: bool = False):
        self.spark, self.root, self.buckets, self.enforce = spark, root, buckets, enforce

    #: How often a batch is made anew because others were stored first.
    ATTEMPTS = 5

    def _fs_path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, *parts))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, table: str, prefix: str) -> list[int]:
        """Folder numbers, by one listing through the path's file system."""
        path, fs = self._fs_path(table)
        if not fs.exists(path):
            return []
        found = (re.fullmatch(prefix + r"=(\d+)", x.getPath().getName()) for x in fs.listStatus(path))
        return sorted(int(m.group(1)) for m in found if m)

    def _complete(self, table: str, folder: str) -> bool:
        path, fs = self._fs_path(table, folder, "_SUCCESS")
        return fs.exists(path)

    def _bucket(self, key: str):
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version that holds each bucket."""
        for v in reversed(self._folders("manifest", "v")):
            if (before is None or v < before) and self._complete("manifest", f"v={v}"):
                rows = self.spark.read.parquet(os.path.join(self.root, "manifest", f"v={v}")).collect()  # a row a bucket
                return {r.bucket: r.version for r in rows}
        return {}

    def listings(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        held = self.manifest(before)
        paths = [os.path.join(self.root, "listings", f"v={v}", f"bucket={b}") for b, v in sorted(held.items())
                 if only is None or b in only]
        if not paths:
            return None
        # a version from before a column was added lacks it: read with today's schema
        return self.spark.read.schema(STATE_SCHEMA).parquet(*paths)

    def _compacted(self, table: str) -> int:
        """The last batch that a complete compacted folder holds, or -1."""
        return max((n for n in self._folders(table, "compact") if self._complete(table, f"compact={n}")), default=-1)

    def log(self, table: str, before: int | None = None) -> DataFrame | None:
        """Rows of the stored batches with ``batch``: the newest compacted folder
        and the batches after it."""
        done = self._compacted(table)
        if before is not None and before <= done:
            raise ValueError(f"{table}: batches up to {done} are compacted and cannot be told apart from {before} on")
        batches = [b for b in self._folders(table, "batch") if b > done and (before is None or b < before)
                   and self._complete("manifest", f"v={b}")]
        parts, read = [], self.spark.read
        if table == "price_history":  # a batch without new prices leaves no file to tell the columns
            read = read.schema("listing_id string, price int, observed_at timestamp, batch int, bucket int")
        if done >= 0:
            parts.append(read.parquet(os.path.join(self.root, table, f"compact={done}")))
        if batches:
            paths = [os.path.join(self.root, table, f"batch={b}") for b in batches]
            parts.append(read.option("basePath", os.path.join(self.root, table)).parquet(*paths))
        return functools.reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def compact(self, table: str = "price_history", keep: int = 2) -> int:
        """Fold all stored batches but the newest ``keep`` (which may be retried)
        into one folder; returns the last batch in it, -1 if there is none.

        Folders that an earlier compaction covered go now, and not those of this
        one, so that running reads of the last version still find their files.
        """
        stored = [b for b in self._folders(table, "batch") if self._complete("manifest", f"v={b}")]
        before = self._compacted(table)
        last = max(sorted(stored)[:-keep] if keep else stored, default=-1)
        if last <= before:
            return before
        later = [b for b in stored if b > last]
        rows = self.log(table).where(~F.col("batch").isin(later))
        if "bucket" in rows.columns:
            write = rows.repartition("bucket").write.partitionBy("bucket")
        else:
            write = rows.coalesce(1).write  # a row a run and source
        write.mode("overwrite").parquet(os.path.join(self.root, table, f"compact={last}"))
        for prefix, gone in (("batch", lambda n: n <= before), ("compact", lambda n: n < before)):
            for n in filter(gone, self._folders(table, prefix)):
                path, fs = self._fs_path(table, f"{prefix}={n}")
                fs.delete(path, True)
        return last

    def _base(self, batch_no: int) -> int:
        return max((v for v in self._folders("manifest", "v") if v < batch_no and self._complete("manifest", f"v={v}")),
                   default=-1)

    def _claim(self, base: int, batch_no: int) -> bool:
        """Whether the batch is the one that goes on top of version ``base``."""
        path, fs = self._fs_path("claims", f"after={base}")
        try:
            out = fs.create(path, False)  # fails if it is there
        except Py4JJavaError:
            file = fs.open(path)
            owner = bytes(file.readNBytes(32)).decode()
            file.close()
            return owner == str(batch_no)
        out.write(bytearray(str(batch_no).encode()))
        out.close()
        return True

    def apply_batch(self, batch_no: int, batch: DataFrame, run_ids: DataFrame, order: str | list[str],
                    observed_at: F.Column) -> None:
        """Store batch ``batch_no``: upsert listings, extend the price log, log runs."""
        if self.enforce:
            runs = {"scrape_runs": run_ids.select("id")}
            rows = constraints.checked(batch, constraints.LISTINGS, runs)
            constraints.rejected(rows).write.mode("overwrite").parquet(
                os.path.join(self.root, "quarantine", f"batch={batch_no}"))
            batch = constraints.accepted(rows)
        for _ in range(self.ATTEMPTS):
            base = self._base(batch_no)
            self._write(batch_no, batch, run_ids, order, observed_at)
            if self._claim(base, batch_no):
                self._commit(batch_no)
                return
            if self._base(batch_no) == base:
                raise ConflictingBatch(f"another batch than {batch_no} was claimed or stored on version {base}")
        raise ConflictingBatch(f"batch {batch_no}: other batches were stored first, {self.ATTEMPTS} times")

    def _write(self, batch_no, batch, run_ids, order, observed_at) -> None:
        """The batch's own folders, which no reader sees before the manifest."""
        touched = sorted(r[0] for r in batch.select(self._bucket("id")).distinct().collect())
        target = os.path.join(self.root, "listings", f"v={batch_no}")
        now = upsert(self.listings(batch_no, touched), batch, order).withColumn("bucket", self._bucket("id"))
        now.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        history = self.log("price_history", before=batch_no)
        if history is not None:
            history = history.where(F.col("bucket").isin(touched))
        increment = price_log_increment(history, price_observations(batch, observed_at))
        increment.withColumn("bucket", self._bucket("listing_id")).repartition("bucket").write.mode(
            "overwrite").partitionBy("bucket").parquet(os.path.join(self.root, "price_history", f"batch={batch_no}"))
        by_run = "scrape_run_id" in batch.columns and not isinstance(order, str)
        run_log(batch.withColumn("_run", F.col("scrape_run_id")) if by_run else batch,
                run_ids.withColumn("_run", F.col("id")) if by_run else run_ids,
                ["_run", "source"] if by_run else None).write.mode("overwrite").parquet(
            os.path.join(self.root, "scrape_runs", f"batch={batch_no}"))

    def _commit(self, batch_no: int) -> None:
        held = self.manifest(before=batch_no)
        touched = self._folders(f"listings/v={batch_no}", "bucket")
        rows = sorted((held | dict.fromkeys(touched, batch_no)).items())
        self.spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(
            os.path.join(self.root, "manifest", f"v={batch_no}"))

    def retire(self, keep: int = 2) -> int:
        """Remove bucket folders that none of the newest ``keep`` manifests
        names; returns how many."""
        newest = self._folders("manifest", "v")[-keep:]
        live = {(v, b) for n in newest for b, v in self.manifest(before=n + 1).items()}
        gone = 0
        for v in self._folders("listings", "v"):
            for b in self._folders(f"listings/v={v}", "bucket"):
                if (v, b) not in live and newest and v < newest[0]:
                    path, fs = self._fs_path("listings", f"v={v}", f"bucket={b}")
                    gone += bool(fs.delete(path, True))
        return gone
