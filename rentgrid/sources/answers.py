"""Posts to listings through a caller's extractor, resumable.

Extractors are slow and fail, so every answer is stored as soon as its part of
the posts is done, under the digest of the text that was asked.  A retried or
later job asks only for texts without an answer; a text that occurs in many
posts is asked once.  Answers that are no JSON object are kept apart with the
reason and not asked again, unless that is wanted.

``root/answers/part=...`` and ``root/rejected/part=...`` hold ``digest,
answer[, reason]``, one folder for each part of a run.  A part is one Spark
write, so a failed part leaves nothing behind, and the parts before it stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rentgrid.operators.graph import checkpointed
from rentgrid.sources import posts

ANSWER = "digest string, answer string"


class AnswerStore:
    """Answers by text digest under ``root`` (shared storage on a cluster)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.root}/{table}/part=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        # the same text may have been asked by two jobs at once
        return found.groupBy("digest").agg(*[F.min(c).alias(c) for c in found.columns if c != "digest"])

    def answers(self) -> DataFrame:
        return self._read("answers", ANSWER)

    def rejected(self) -> DataFrame:
        return self._read("rejected", ANSWER + ", reason string")

    def ask(self, texts: DataFrame, extractor: Callable, parts: int = 16, retry_rejected: bool = False) -> int:
        """Ask for the ``text`` of each ``digest`` that has no answer yet, part
        by part; returns how many were asked.  ``extractor`` takes and gives an
        iterator of pandas frames: (digest, text) to (digest, answer)."""
        todo = texts.groupBy("digest").agg(F.min("text").alias("text")).join(self.answers(), "digest", "left_anti")
        if not retry_rejected:
            todo = todo.join(self.rejected(), "digest", "left_anti")
        todo = checkpointed(todo.withColumn("_part", F.pmod(F.xxhash64("digest"), F.lit(parts))))
        run, asked = uuid.uuid4().hex, 0
        for row in todo.groupBy("_part").count().orderBy("_part").collect():  # at most ``parts`` rows
            part = todo.where(F.col("_part") == row["_part"]).select("digest", "text")
            given = checkpointed(posts.extract_with(part, extractor, ANSWER))
            kind = F.schema_of_variant(F.try_parse_json(posts.unfence(F.col("answer"))))
            reason = F.when(F.col("answer").isNull(), "no answer").when(kind.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object")
            judged = given.withColumn("reason", reason)
            name = f"part={run}-{row['_part']}"
            judged.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{self.root}/rejected/{name}")
            judged.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{self.root}/answers/{name}")
            asked += row["count"]
        return asked


def listings_of_posts(captured: DataFrame, key: str, text: str, store: AnswerStore, extractor: Callable, url: str | None = None,
                      extracted_at=None, **how) -> DataFrame:
    """Captured posts to listings: cleaned, too short ones left out, asked
    where no answer is stored, and the stored answers decoded for every post.

    ``key`` names a column that tells posts apart; it is kept.  Posts without
    a text are left out; posts of one text share its answer."""
    rows = captured.select(F.col(key), F.col(text).alias("text"), (F.col(url) if url else F.lit("")).alias("post_url"))
    rows = posts.extraction_candidates(posts.normalize_posts(rows), "text").withColumn("digest", F.sha2("text", 256))
    store.ask(rows.select("digest", "text"), extractor, **how)
    answered = rows.join(store.answers(), "digest").select(key, "answer", "post_url")
    return posts.decode_answers(answered, key, "answer", "post_url", extracted_at)
