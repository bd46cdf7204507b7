"""Captured posts as a stream, de-duplicated on their first 100 characters
(G3/I4 in streaming form): the first post of every text key is kept.

What was seen is keyed state: one entry per text key in a RocksDB state store,
read only for the keys of a micro-batch, never as a table.  Of the posts of a
key in one micro-batch the earliest by ``(extracted_at, seq)`` counts; the
posts of an Arrow batch are reduced to it before the shuffle, so a key with a
large share of all posts is one row per batch.  Post files that arrive later
count as later posts.  A micro-batch writes only its own folder, and a
restarted one starts from the state before it, so the output is the same after
a failure and in another process.  Empty texts are dropped first.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from rentgrid.functions import patterns as P

POST_SCHEMA = ("seq long, text string, author string, timestamp_text string, post_url string, "
               "extracted_at timestamp")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("text").isNotNull() & (F.length("text") > 0))
              .withColumn("text_key", F.substring("text", 1, P.POST_DEDUP_PREFIX_CHARS)))


def _earliest(frames):
    """Of each text key in a batch of rows the earliest one."""
    for pdf in frames:
        yield pdf.sort_values(["extracted_at", "seq"], kind="stable", na_position="first").drop_duplicates("text_key")


def _first_seen(key, frames, state):
    """The earliest post of a key that no micro-batch had before."""
    known, best = state.exists, None
    for pdf in frames:
        if not known:
            best = next(_earliest([pdf if best is None else pd.concat([best, pdf])]))
    if best is not None:
        state.update((True,))
        yield best


def first_posts(posts: DataFrame) -> DataFrame:
    """The stream of posts whose text key was not seen before."""
    keyed = _keyed(posts)
    combined = keyed.mapInPandas(_earliest, keyed.schema)
    return combined.groupBy("text_key").applyInPandasWithState(
        _first_seen, keyed.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_location: str):
    """Read post files, keep the first post per text key; returns the query.
    Output: ``sink_dir/posts/batch=N``.  ``checkpoint_location`` must be the
    same shared folder in every process that goes on with the stream; it holds
    the state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.drop("text_key").write.mode("overwrite").parquet(os.path.join(sink_dir, "posts", f"batch={batch_id}"))
    stream = first_posts(spark.readStream.schema(POST_SCHEMA).json(source_dir))
    old = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()
    finally:  # the query keeps the settings that it was started with
        spark.conf.unset(_STORE) if old is None else spark.conf.set(_STORE, old)
