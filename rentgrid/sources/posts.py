"""Posts: dump splitting, post records, model answers.

A post's text is turned into a listing by a caller-supplied extractor (the
source used a remote language model; no model is called here).  What this
module does on Spark:

* ``split_dumps``: a pasted dump is split on ``---``; pieces are stripped
  and empty ones dropped (``posexplode`` keeps the piece position);
* ``normalize_posts``: three or more newlines become two, text stripped;
* ``post_images``: keep images whose link contains ``scontent``, not
  ``emoji``, with a numeric width over 100;
* ``extraction_candidates``: posts shorter than 20 stripped characters are
  skipped before any extractor runs;
* ``extract_with``: runs a batch extractor ``fn(pandas.DataFrame) ->
  pandas.DataFrame`` through ``mapInPandas`` (Arrow batches);
* ``decode_answers``: model answers (JSON text, possibly inside one code
  fence) -> listings; bad JSON gives no row, ``is_offering`` missing counts
  as false, the type is mapped to the closed set, ``available_date`` is
  read as ISO, the price is taken as given and only the neighbourhood rule
  is applied to the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.functions import patterns as P
from rentgrid.functions.dialect import SPARK
from rentgrid.functions.extract import neighbourhood
from rentgrid.functions.stages import apply_stages
from rentgrid.operators.enrich import fold_column
from rentgrid.schema import ANSWER_KEYS, LISTING_FIELDS, LISTING_TYPES_BY_NAME, as_listings


def strip(c: Column) -> Column:
    """Python ``str.strip()``: all Unicode whitespace at both ends."""
    return SPARK.strip(c)


def split_dumps(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, post): pieces of each dump, stripped, empty ones dropped."""
    pieces = df.select(id_col, F.posexplode(F.split(F.col(text_col), re.escape(P.DUMP_SEPARATOR)))
                       .alias("pos", "piece"))
    return (pieces.select(id_col, "pos", strip(F.col("piece")).alias("post"))
                  .filter(F.length("post") > 0))


def normalize_posts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Runs of 3+ newlines -> 2, then strip."""
    return df.withColumn(text_col, strip(F.regexp_replace(F.col(text_col), P.POST_NEWLINES_PATTERN, "\n\n")))


def post_images(images: Column) -> Column:
    """array<struct<src, width>> -> array<src> kept by the image rules.  A
    width that is not a number drops that image only."""
    kept = F.filter(images, lambda i: i["src"].contains("scontent") & ~i["src"].contains("emoji")
                    & (i["width"].try_cast("int") > 100))
    return F.transform(kept, lambda i: i["src"])


def extraction_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """Posts with at least MIN_POST_CHARS stripped characters."""
    return df.filter(F.length(strip(F.col(text_col))) >= P.MIN_POST_CHARS)


def extract_with(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """Run a batch extractor over candidate posts with Arrow batches."""
    return df.mapInPandas(fn, schema)


def unfence(answer: Column) -> Column:
    """Strip; an answer starting with a code fence loses its first and last line."""
    t = strip(answer)
    lines = F.split(t, "\n")
    inner = F.when(F.size(lines) > 2, F.array_join(F.slice(lines, 2, F.size(lines) - 2), "\n")).otherwise(F.lit(""))
    return F.when(t.startswith("```"), inner).otherwise(t)


def decode_answers(df: DataFrame, id_col: str, answer_col: str, url_col: str | None = None,
                   extracted_at: Column | None = None) -> DataFrame:
    """Model answers -> offering listings: ``id_col`` and all listing columns.

    Every key of the answer is read as the type of its column; the id is a
    digest of source, url, title and description, as for captured posts
    without an own id (unless ``id_col`` is ``id``: then the caller's).  ``extracted_at`` is when the answers were taken.

    Each answer is stripped, un-fenced and parsed once into a VARIANT
    column; fields are then read with ``try_variant_get``.  The parse sits
    in a one-row generator, so the offer filter (which reads the parsed
    value) stays above it instead of being pushed down with a second parse.
    An answer counts as an offer when its ``is_offering`` value is truthy.
    """
    from rentgrid.sources.jsonld import _truthy
    t = F.col("_t")
    lines = F.split(t, "\n")
    stages = [
        {"_t": strip(F.col(answer_col))},
        {"_body": F.when(t.startswith("```"),
                         F.when(F.size(lines) > 2, F.array_join(F.slice(lines, 2, F.size(lines) - 2), "\n"))
                         .otherwise(F.lit(""))).otherwise(t)},
    ]
    v = F.col("_v")
    get = lambda path, typ="string": F.try_variant_get(v, path, typ)
    title = F.coalesce(get("$.title"), F.lit("Facebook listing"))
    location = F.coalesce(get("$.location"), F.lit(""))
    description = F.coalesce(get("$.description"), F.lit(""))
    ltype = F.coalesce(get("$.listing_type"), F.lit("other"))
    final = {
        id_col: F.col(id_col),
        "url": F.col(url_col) if url_col else F.lit(""),
        "source": F.lit("facebook"),
        "title": title,
        "price": get("$.price", "int"),
        "location": location,
        "description": description,
        "listing_type": F.when(ltype.isin(list(P.LISTING_TYPES)), ltype).otherwise(F.lit("other")),
        "available_date": SPARK.try_iso_timestamp(get("$.available_date")),
        **{name: get(f"$.{name}", LISTING_TYPES_BY_NAME[name]) for name in ANSWER_KEYS},
        "image_urls": F.array().cast("array<string>"),
        # a path lookup on a non-object gives NULL, so such answers drop out
        "_offer": _truthy(v, "$.is_offering").isNotNull(),
    }
    # parse once inside a one-row generator: the offer filter reads the
    # parsed value and cannot be pushed below it, so no answer is parsed twice
    staged = apply_stages(df, stages, {c: F.col(c) for c in [id_col, "_body"] + ([url_col] if url_col else [])})
    parsed = staged.select("*", F.explode(F.array(F.try_parse_json(F.col("_body")))).alias("_v"))
    out = apply_stages(parsed, [], final).filter(F.col("_offer")).drop("_offer")
    loc_text = F.concat(F.col("location"), F.lit(" "), F.col("title"), F.lit(" "), F.col("description"))
    staged = out.withColumn("_loc", loc_text).withColumn("_loc_fold", fold_column(F.col("_loc")))
    out = (staged.withColumn("neighbourhood", neighbourhood(SPARK, F.col("_loc"), guard_text=F.col("_loc_fold")))
                 .withColumn("extracted_at", F.lit(None).cast("timestamp") if extracted_at is None else extracted_at))
    if id_col == "id":  # the caller's own ids
        return as_listings(out, [f for f in LISTING_FIELDS if f[0] != "id"], keep=["id"])
    out = out.withColumn("id", SPARK.sha_id("fb-", F.col("source"), F.col("url"), F.col("title"), F.col("description")))
    return as_listings(out, keep=[id_col])


def post_records(df: DataFrame) -> DataFrame:
    """Captured posts -> post records: text with 3+ newlines cut to 2 and
    stripped, author and timestamp text stripped, kept images, and the
    first link that is a post permalink (``/posts/`` or ``/permalink/``).

    Input columns: ``seq``, ``text``, ``author``, ``timestamp_text``,
    ``links`` (array<string>), ``images`` (array<struct<src, width>>),
    ``extracted_at``.
    """
    permalink = F.try_element_at(F.filter(F.col("links"), lambda h: h.contains("/posts/") | h.contains("/permalink/")),
                                 F.lit(1))
    return df.select(
        "seq",
        strip(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), P.POST_NEWLINES_PATTERN, "\n\n")).alias("text"),
        strip(F.coalesce(F.col("author"), F.lit(""))).alias("author"),
        strip(F.coalesce(F.col("timestamp_text"), F.lit(""))).alias("timestamp"),
        post_images(F.col("images")).alias("image_urls"),
        F.coalesce(permalink, F.lit("")).alias("post_url"),
        "extracted_at",
    )
