"""Snapshot folder -> keyed listing state, as a Structured Streaming job.

New snapshot files are picked up by a file stream; each micro-batch is
applied to the :class:`~rentgrid.operators.state.ListingStore` (upsert, price
log, run log) with the micro-batch id as batch number.  Rows apply in the order
of (date, time, extraction time, position in the snapshot), however files are
packed.  A run is (date, time, source): its id is a hash of these, so a
snapshot whose files fall into two batches is still one run.  With
``trigger(availableNow=True)`` the job processes what has arrived and stops,
which fits a daily schedule.

The checkpoint location is an argument: it must be the same folder, on shared
storage, in every process that goes on with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.operators.state import ListingStore
from rentgrid.sources.snapshots import JSON_OPTIONS, SNAPSHOT_SCHEMA

ORDER = ["date", "time", "extracted_at", "position"]


def _apply(store: ListingStore):
    def fn(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("scrape_run_id", F.xxhash64("date", "time", "source"))
        # a batch is read several times (state and logs): keep it for this call only
        rows = rows.persist()
        try:
            runs = rows.groupBy("source", F.col("scrape_run_id").alias("id")).agg(
                F.min("extracted_at").alias("started_at"), F.max("extracted_at").alias("finished_at"))
            store.apply_batch(batch_id, rows, runs, ORDER, F.col("extracted_at"))
        finally:
            rows.unpersist()
    return fn


def start(spark: SparkSession, snapshot_prefix: str, store_root: str, checkpoint_location: str,
          available_now: bool = True, max_files: int | None = None):
    """Start the stream; returns the StreamingQuery (call awaitTermination).
    ``max_files`` bounds the files of a micro-batch."""
    reader = spark.readStream.schema(SNAPSHOT_SCHEMA).options(**JSON_OPTIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (reader.json(snapshot_prefix).writeStream.foreachBatch(_apply(ListingStore(spark, store_root)))
                    .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")
    return writer.start()
