"""From raw documents to token ids: five stages, each on what the one before
kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next one's ``docs``.  All but the last return the columns of ``documents``;
other columns of the input, whatever their names, are not read.

Rows, not ids, are what a stage keeps or drops: a stage that joins decisions to
rows numbers its rows first (``_numbered``) and joins on the number, so null
ids, repeated rows and one id with several texts neither lose nor multiply a
document.  Null and empty texts are one exact class, are alone in the n-gram
join and have no words to mix, so the mixing stage does not take them.  A table
without rows gives a result without rows.  A very long text is worked on whole
by one task in each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.llm import bpe, dedup_stream, mixing, parity_join, toxicity
from rentgrid.llm.queries import VOCABULARY
from rentgrid.llm.tables import read, shared_path, sized, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go (operator 6)."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The rows with a number each (``_row``), as a written table and its path."""
    path = shared_path(spark, name)
    rows = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    return path, spark.read.schema(rows.schema).parquet(path)


def _without_others(rows: DataFrame, members: DataFrame, order: Column) -> DataFrame:
    """The rows without those members (``_row``, ``_class``) of a class that
    come behind another one in ``order``."""
    members = members.join(rows.select("_row", "doc_id"), "_row")
    first = written(members.groupBy("_class").agg(F.min(F.struct(order, "_row"))["_row"].alias("_stays")), "pipeline-first")
    dropped = written(members.join(sized(first), "_class").where("_row <> _stays").select("_row"), "pipeline-dropped")
    return rows.join(sized(dropped), "_row", "left_anti").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest id stays (operator 8)."""
    path, rows = _numbered(spark, docs, "pipeline-exact")
    setting = "spark.sql.streaming.stateStore.maintenanceInterval"
    old = spark.conf.get(setting, None)
    spark.conf.set(setting, "5s")  # the stores of the ended stream leave memory before the next stage
    try:
        classes = dedup_stream.exact_dedup(spark, path, "_row")
    finally:
        spark.conf.unset(setting) if old is None else spark.conf.set(setting, old)
    members = written(classes.where("group_size > 1").select("_row", F.col("keep_id").alias("_class")), "pipeline-members")
    return _without_others(rows, members, F.struct(F.col("doc_id").isNull(), -F.col("doc_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row with the smallest id stays (operator 10)."""
    _, rows = _numbered(spark, docs, "pipeline-near")
    groups = parity_join.similar_groups(rows, "_row").where("component_id <> doc_id")
    linked = written(groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class")), "pipeline-members")
    roots = linked.select(F.col("_class").alias("_row"), "_class").distinct()
    return _without_others(rows, linked.unionByName(roots), F.struct(F.col("doc_id").isNull(), "doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times (operator 1)."""
    _, rows = _numbered(spark, docs, "pipeline-rows")
    mixed = written(mixing.mix(rows, carry=("_row",)).where("taken > 0").select(
        "_row", (F.col("taken") / F.col("size")).cast("int").alias("_times")), "pipeline-mix")
    out = rows.join(sized(mixed), "_row")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digest of what they decode to (operator 2)."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", clean_of_toxic),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Weak supervision and byte-pair merges are beyond SQL; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = written(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
