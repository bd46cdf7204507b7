"""Exact dedup as a stateful stream (operator 8).

The table is read as a file stream.  The only state is one row per distinct
normalised text, kept without expiry in RocksDB: the digest (key), the number
of rows, the stable identifier (largest ``doc_id``) and the content locator
(file and ``doc_id`` of one row that holds the text).  Texts never enter the
state.  Every digest that was hit more than once is then checked on full
bytes: the texts of its rows are grouped by (digest, text), so a hash equality
alone never makes two texts equal.

All on DataFrame functions; nothing here runs Python on an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.llm.tables import ascii_lower, shared_path, written

#: Bytes of input that one micro-batch takes (bounds its shuffle and retries).
MAX_BYTES_PER_TRIGGER = 64 << 30

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # many small stores: no disk set aside for each one's logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_norm`` (A-Z lower-cased, null as empty) and its SHA-256."""
    out = df.withColumn("_norm", ascii_lower(F.coalesce(F.col(text), F.lit(""))))
    # never null, and known to be: else every join computes it twice, to filter nulls
    return out.withColumn("_digest", F.coalesce(F.sha2("_norm", 256), F.lit("")))


def digest_state(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text",
                 checkpoint: str | None = None, max_bytes: int = MAX_BYTES_PER_TRIGGER) -> DataFrame:
    """One row per digest: ``digest, group_size, keep_id, locator``.

    Streams the files at ``path`` (those not yet taken, if ``checkpoint``
    names the folder of an earlier run, which goes on from its state) and
    reads the result from the state store.  An interrupted run restarts from
    the checkpoint without counting a row twice.
    """
    old = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    checkpoint = checkpoint or shared_path(spark, "dedup-state")
    schema = spark.read.parquet(path).select(key, text).schema
    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern: a stream takes a folder or a pattern, not one file
    try:
        for k, v in _STATE_CONF.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(files)
        rows = normalised(stream.withColumn("_file", F.input_file_name()), text)
        groups = rows.groupBy(F.col("_digest").alias("digest")).agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct(F.col(key).alias("id"), F.col("_file").alias("file"))).alias("locator"))
        query = (groups.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
                 .option("checkpointLocation", checkpoint).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    digest = f"key.`{state.schema['key'].dataType.names[0]}`"
    value = [f"value.`{c}`" for c in state.schema["value"].dataType.names]
    return state.select(F.col(digest).alias("digest"), F.col(value[0]).alias("group_size"),
                        F.col(f"{value[1]}.id").alias("keep_id"), F.col(value[1]).alias("locator"))


def exact_classes(rows: DataFrame, state: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, keep_id, group_size, _digest`` of every row of ``rows``.

    ``rows`` has ``_norm`` and ``_digest``.  Rows are grouped by (digest,
    bytes) with map-side combining, so a text that a third of all rows share
    is one row per task.  If a digest turns out to have more than one text (a
    collision), its rows are classed by the text itself; else by the digest.
    """
    texts = rows.groupBy("_digest", "_norm").agg(F.count(F.lit(1)).alias("_n"))
    clash = written(texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1")
                    .select("_digest"), "dedup-collisions")
    classed = state.select(F.col("digest").alias("_digest"), "group_size", "keep_id")
    cols = [key, "keep_id", "group_size", "_digest"]
    if clash.isEmpty():
        return rows.select(key, "_digest").join(classed, "_digest").select(*cols)
    plain = rows.select(key, "_digest").join(classed.join(clash, "_digest", "left_anti"), "_digest")
    split = rows.select(key, "_digest", "_norm").join(clash, "_digest", "left_semi")
    keeps = split.groupBy("_digest", "_norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(key).alias("keep_id"))
    return plain.select(*cols).unionByName(split.join(keeps, ["_digest", "_norm"]).select(*cols))


def exact_dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text",
                checkpoint: str | None = None) -> DataFrame:
    """Every row of the table at ``path`` with its class.

    ``key, keep_id, group_size, kept, text_sha256``: of equal texts (identical
    after lower-casing A-Z; null counts as empty) the row with the largest key
    stays.  An empty table gives no rows; empty texts form one class; repeated
    rows with one key are all kept if that key is the largest; rows with a null
    key take part as the smallest.  Other columns are never read.
    """
    state = written(digest_state(spark, path, key, text, checkpoint), "dedup-digests")
    rows = normalised(spark.read.parquet(path).select(key, text), text).drop(text)
    out = exact_classes(rows, state, key)
    return out.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("_digest").alias("text_sha256"))
