"""Registered queries: name -> (Spark plan, oracle SQL or None).

Every Spark plan reads the given tables (or data Spark derives from them)
in full; every oracle is DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import capture as _C
from rentgrid.functions import patterns as P
from rentgrid.functions.dialect import DUCK
from rentgrid.functions.extract import PARSED_COLUMNS, clean_text, neighbourhood
from rentgrid.functions.extract import extract_price as _extract_price
from rentgrid.operators import dedup, market, query, state, stats
from rentgrid.operators.enrich import enrich, parse_text, parse_text_sql
from rentgrid.plans.base import enriched, listings, with_ctes
from rentgrid.schema import ANSWER_KEYS, LISTING_COLUMNS, LISTING_FIELDS, LISTING_TYPES_BY_NAME
from rentgrid.session import computed, read_table, rebalance
from rentgrid.sources import details as _details
from rentgrid.sources import jsonld, posts, search_cards, site_pages, snapshots
from rentgrid.sources import registry as _registry
from rentgrid.sources.captures import decode
from rentgrid.sources.fixture import AS_OF, listing_raw, model_answers, model_answers_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# --------------------------------------------------------------------------
# Flagship: price level per neighbourhood over enriched listings.
# --------------------------------------------------------------------------
def neighbourhood_price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = enriched(spark, sf_dir)
    priced = F.when(F.col("price") != 0, F.col("price"))
    return (df.groupBy("neighbourhood")
              .agg(F.count(F.lit(1)).alias("listings"),
                   F.count(priced).alias("priced"),
                   F.min(priced).alias("min_price"),
                   F.max(priced).alias("max_price"),
                   F.round(F.avg(priced), 2).alias("avg_price")))


register("neighbourhood_price_stats", with_ctes("""
SELECT neighbourhood, count(*) AS listings, count(p) AS priced, min(p) AS min_price, max(p) AS max_price,
       round(avg(p), 2) AS avg_price
FROM (SELECT neighbourhood, CASE WHEN price <> 0 THEN price END AS p FROM enriched) t
GROUP BY neighbourhood
""", "enriched"))(neighbourhood_price_stats)


# --------------------------------------------------------------------------
# The enriched listing table itself (all 55 columns; images as text).
# --------------------------------------------------------------------------
def _listing_projection(df: DataFrame) -> DataFrame:
    cols = [F.array_join("image_urls", "|").alias("image_urls") if c == "image_urls" else F.col(c)
            for c in LISTING_COLUMNS]
    return df.select(*cols)


def _listing_projection_sql() -> str:
    return ", ".join("array_to_string(image_urls, '|') AS image_urls" if c == "image_urls" else c
                     for c in LISTING_COLUMNS)


@register("decode_listings", with_ctes(f"SELECT {_listing_projection_sql()} FROM listings", "listings"))
def decode_listings(spark, sf_dir):
    return _listing_projection(listings(spark, sf_dir))


@register("enrich_listings", with_ctes(f"SELECT {_listing_projection_sql()} FROM enriched", "enriched"))
def enrich_listings(spark, sf_dir):
    return _listing_projection(enriched(spark, sf_dir))


# One query per derived column: the merged value per listing id and time.
def _one_column(col: str):
    def fn(spark, sf_dir):
        return enriched(spark, sf_dir).select("id", "extracted_at", col)
    return fn


for _name, _ in PARSED_COLUMNS:
    register(f"derive_{_name}", with_ctes(f"SELECT id, extracted_at, {_name} FROM enriched", "enriched"))(
        _one_column(_name))


# --------------------------------------------------------------------------
# Reads: filters, top-k, projections
# --------------------------------------------------------------------------

_LISTING_SQL_COLS = _listing_projection_sql()


@register("get_listings_filtered", with_ctes(f"""
SELECT {_LISTING_SQL_COLS} FROM enriched
WHERE listing_type = 'room_private' AND price >= 500 AND price <= 2000
ORDER BY extracted_at DESC, id, price LIMIT 100""", "enriched"))
def get_listings_filtered(spark, sf_dir):
    # filters and order need no derived column: the rules run on the rows that are kept
    def rows_of(keys=None):
        raw = listing_raw(spark, sf_dir)
        raw = raw if keys is None else raw.join(keys, "listing_key", "left_semi")
        return computed(decode(raw, AS_OF), "listing_type", "price")
    return _listing_projection(enrich(query.get_listings(rows_of(), listing_type="room_private", min_price=500, max_price=2000,
                                                         limit=100, key=["listing_key"], rows_of=rows_of)))


@register("get_listings_source_only", with_ctes(f"""
SELECT {_LISTING_SQL_COLS} FROM enriched WHERE source = 'kijiji'
ORDER BY extracted_at DESC, id, price LIMIT 100""", "enriched"))
def get_listings_source_only(spark, sf_dir):
    # falsy bounds (0) mean "no bound"
    return _listing_projection(enrich(query.get_listings(listings(spark, sf_dir), source="kijiji",
                                                         min_price=0, max_price=0, key=["listing_key"])))


@register("capture_price_bounds", with_ctes("""
SELECT listing_key, id, price FROM listings WHERE price >= 800 AND price <= 1500""", "listings"))
def capture_price_bounds(spark, sf_dir):
    return query.with_price_bounds(listings(spark, sf_dir), 800, 1500).select("listing_key", "id", "price")


@register("titled_listings", with_ctes("""
SELECT listing_key, title FROM listings WHERE length(title) > 0""", "listings"))
def titled_listings(spark, sf_dir):
    return query.has_title(listings(spark, sf_dir)).select("listing_key", "title")


@register("sorted_by_price", with_ctes("""
SELECT listing_key, id, price FROM listings WHERE price IS NOT NULL AND price <> 0
ORDER BY price, id""", "listings"))
def sorted_by_price(spark, sf_dir):
    return query.sorted_by_price(listings(spark, sf_dir)).select("listing_key", "id", "price")


@register("first_per_source", with_ctes("""
SELECT listing_key, snapshot_no, source, id FROM listings
QUALIFY row_number() OVER (PARTITION BY snapshot_no, source ORDER BY listing_key) <= 50""", "listings"))
def first_per_source(spark, sf_dir):
    # every snapshot is one run: the first 50 listings of each source in it
    return query.first_per_source(listings(spark, sf_dir), 50, ["listing_key"], ["snapshot_no"]) \
        .select("listing_key", "snapshot_no", "source", "id")


# --------------------------------------------------------------------------
# Aggregations
# --------------------------------------------------------------------------
_POSITIONS_SQL = """
WITH p AS (SELECT {g}price FROM enriched WHERE price IS NOT NULL AND price <> 0),
h AS (SELECT {g}price, count(*) AS c FROM p GROUP BY {g}price),
c AS (SELECT {g}price, sum(c) OVER (PARTITION BY {gp} ORDER BY price ROWS UNBOUNDED PRECEDING) AS cum,
             sum(c) OVER (PARTITION BY {gp}) AS n FROM h),
q AS (SELECT {g}min(CASE WHEN cum > floor(n * 1 / 2) THEN price END) AS median_price,
             min(CASE WHEN cum > floor(n * 1 / 4) THEN price END) AS p25_price,
             min(CASE WHEN cum > floor(n * 3 / 4) THEN price END) AS p75_price FROM c {gb}),
b AS (SELECT {g}count(*) AS listings, count(pp) AS priced, min(pp) AS min_price, max(pp) AS max_price,
             round(avg(pp), 2) AS avg_price
      FROM (SELECT {g}CASE WHEN price <> 0 THEN price END AS pp FROM enriched) t {gb})
SELECT b.*, q.median_price, q.p25_price, q.p75_price FROM b LEFT JOIN q ON {on}
"""


@register("price_summary", with_ctes(_POSITIONS_SQL.format(g="", gp="1", gb="", on="TRUE"), "enriched"))
def price_summary(spark, sf_dir):
    return stats.price_summary(enriched(spark, sf_dir))


@register("price_summary_by_source", with_ctes(_POSITIONS_SQL.format(
    g="source, ", gp="source", gb="GROUP BY source", on="b.source = q.source"), "enriched"))
def price_summary_by_source(spark, sf_dir):
    return stats.price_summary(enriched(spark, sf_dir), ["source"])


@register("count_by_source", with_ctes("SELECT source, count(*) AS listings FROM enriched GROUP BY source",
                                       "enriched"))
def count_by_source(spark, sf_dir):
    return stats.count_by(enriched(spark, sf_dir), "source")


@register("count_by_type", with_ctes(
    "SELECT listing_type, count(*) AS listings FROM enriched GROUP BY listing_type", "enriched"))
def count_by_type(spark, sf_dir):
    return stats.count_by(enriched(spark, sf_dir), "listing_type")


@register("price_coverage", with_ctes("""
SELECT count(CASE WHEN price <> 0 THEN price END) AS priced, count(*) AS listings,
       round(count(CASE WHEN price <> 0 THEN price END) / count(*), 4) AS coverage FROM listings""", "listings"))
def price_coverage(spark, sf_dir):
    return stats.price_coverage(listings(spark, sf_dir))


# --------------------------------------------------------------------------
# Set operations and deduplication
# --------------------------------------------------------------------------
@register("union_sources", with_ctes("SELECT listing_key, source, id FROM listings", "listings"))
def union_sources(spark, sf_dir):
    df = listings(spark, sf_dir)
    parts = [df.filter(F.col("source") == s) for s in P.SOURCES]
    return dedup.union_sources(parts).select("listing_key", "source", "id")


@register("merge_snapshots", with_ctes("""
SELECT coalesce(id, url, '') AS merge_key, id, url, snapshot_no, listing_key, price, title FROM enriched
QUALIFY row_number() OVER (PARTITION BY coalesce(id, url, '') ORDER BY snapshot_no DESC, listing_key DESC) = 1
""", "enriched"))
def merge_snapshots(spark, sf_dir):
    # carry only the reported columns: the merged row struct would otherwise
    # keep every derived column alive through the aggregate
    cols = ["id", "url", "snapshot_no", "listing_key", "price", "title"]
    merged = dedup.merge_snapshots(enriched(spark, sf_dir).select(*cols))
    return merged.select(F.coalesce("id", "url", F.lit("")).alias("merge_key"), "id", "url", "snapshot_no",
                         "listing_key", "price", "title")


@register("latest_snapshot", with_ctes("""
SELECT listing_key, id FROM listings WHERE snapshot_no = (SELECT max(snapshot_no) FROM listings)""", "listings"))
def latest_snapshot(spark, sf_dir):
    return dedup.latest_snapshot(listings(spark, sf_dir)).select("listing_key", "id")


@register("dedup_posts", f"""
SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND length(text) > 0
QUALIFY row_number() OVER (PARTITION BY substr(text, 1, {P.POST_DEDUP_PREFIX_CHARS}) ORDER BY doc_id) = 1
""")
def dedup_posts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return dedup.first_posts_of_key(docs, "text", "doc_id", P.POST_DEDUP_PREFIX_CHARS).select("doc_id", "n_chars")


# --------------------------------------------------------------------------
# Keyed state
# --------------------------------------------------------------------------
_SOURCE_RANK = "CASE source WHEN 'craigslist' THEN 1 WHEN 'kijiji' THEN 2 ELSE 3 END"


def _ordered(df: DataFrame) -> DataFrame:
    """Listings as ordered batches: batch = snapshot, run id per (snapshot,
    source), apply order = (snapshot, capture position)."""
    rank = F.expr(_SOURCE_RANK)
    return df.withColumn("scrape_run_id", (F.col("snapshot_no") * 3 + rank).cast("bigint")) \
             .withColumn("_seq", F.col("snapshot_no").cast("bigint") * F.lit(10 ** 12) + F.col("listing_key"))


def _state_sql_cols() -> str:
    from rentgrid.schema import FIRST_WRITER_COLUMNS, STATE_FIELDS
    cols = []
    for n, _ in STATE_FIELDS:
        if n == "id":
            cols.append("id")
            continue
        fn = "arg_min_null" if n in FIRST_WRITER_COLUMNS else "arg_max_null"
        val = "array_to_string(image_urls, '|')" if n == "image_urls" else n
        cols.append(f"{fn}({val}, seq) AS {n}")
    return ", ".join(cols)


_BATCHES_SQL = f"""b AS (SELECT *, CAST(snapshot_no * 3 + {_SOURCE_RANK} AS BIGINT) AS scrape_run_id,
                 CAST(snapshot_no AS BIGINT) * 1000000000000 + listing_key AS seq FROM enriched)"""


@register("upsert_state", with_ctes(f"""WITH {_BATCHES_SQL}
SELECT {_state_sql_cols()} FROM b GROUP BY id""", "enriched"))
def upsert_state(spark, sf_dir):
    out = state.first_state(_ordered(listings(spark, sf_dir)), "_seq", enrich)
    return out.withColumn("image_urls", F.array_join("image_urls", "|"))


@register("upsert_batches", with_ctes(f"""WITH {_BATCHES_SQL}
SELECT {_state_sql_cols()} FROM b GROUP BY id""", "enriched"))
def upsert_batches(spark, sf_dir):
    """Two batches of two snapshots each, the second applied to the stored state of the first."""
    rows = _ordered(listings(spark, sf_dir))
    stored = state.upsert(None, rows.filter("snapshot_no < 2"), "_seq", enrich)
    out = state.upsert(stored, rows.filter("snapshot_no >= 2"), "_seq", enrich)
    return out.withColumn("image_urls", F.array_join("image_urls", "|"))


@register("price_history_listings", with_ctes("""
SELECT id AS listing_id, CAST(price AS INTEGER) AS price, min(extracted_at) AS observed_at
FROM enriched WHERE price IS NOT NULL AND price <> 0 GROUP BY id, price""", "enriched"))
def price_history_listings(spark, sf_dir):
    obs = state.price_observations(enriched(spark, sf_dir), F.col("extracted_at"))
    return state.first_seen_prices(obs)


_EVENT_OBS_SQL = """SELECT CAST(user_id AS VARCHAR) AS listing_id, CAST(floor(value) AS INTEGER) AS price,
       ts AS observed_at FROM events WHERE CAST(floor(value) AS INTEGER) <> 0"""


def _event_observations(spark, sf_dir) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("user_id", "value", "ts")
    return (ev.select(F.col("user_id").cast("string").alias("listing_id"),
                      F.floor("value").cast("int").alias("price"), F.col("ts").alias("observed_at"))
              .filter(F.col("price") != 0))


@register("price_history_events", f"""
SELECT listing_id, price, min(observed_at) AS observed_at FROM ({_EVENT_OBS_SQL}) o GROUP BY listing_id, price""")
def price_history_events(spark, sf_dir):
    return state.first_seen_prices(_event_observations(spark, sf_dir))


@register("price_log_increment", f"""
WITH o AS ({_EVENT_OBS_SQL}),
hist AS (SELECT DISTINCT listing_id, price FROM o WHERE observed_at < TIMESTAMP '2024-01-20'),
batch AS (SELECT listing_id, price, min(observed_at) AS observed_at FROM o
          WHERE observed_at >= TIMESTAMP '2024-01-20' GROUP BY listing_id, price)
SELECT * FROM batch WHERE NOT EXISTS (
  SELECT 1 FROM hist WHERE hist.listing_id = batch.listing_id AND hist.price = batch.price)""")
def price_log_increment(spark, sf_dir):
    obs = _event_observations(spark, sf_dir)
    cut = F.lit("2024-01-20").cast("timestamp")
    history = state.first_seen_prices(obs.filter(F.col("observed_at") < cut))
    return state.price_log_increment(history, obs.filter(F.col("observed_at") >= cut))


@register("run_log", with_ctes(f"""WITH
runs AS (SELECT DISTINCT snapshot_no, source FROM enriched)
SELECT CAST(r.snapshot_no * 3 + {_SOURCE_RANK.replace('source', 'r.source')} AS BIGINT) AS id,
       TIMESTAMP '{AS_OF}' + to_days(CAST(r.snapshot_no AS INTEGER)) AS started_at,
       CASE WHEN r.snapshot_no < 3 THEN
         TIMESTAMP '{AS_OF}' + to_days(CAST(r.snapshot_no AS INTEGER)) + INTERVAL 5 MINUTE END AS finished_at,
       r.source, CASE WHEN r.snapshot_no = 2 THEN 0 ELSE count(e.id) END AS listings_found,
       CASE WHEN r.snapshot_no = 2 THEN 'failed' WHEN r.snapshot_no = 3 THEN 'running' ELSE 'completed' END AS status
FROM runs r LEFT JOIN enriched e ON e.snapshot_no = r.snapshot_no AND e.source = r.source
GROUP BY r.snapshot_no, r.source""", "enriched"))
def run_log(spark, sf_dir):
    df = listings(spark, sf_dir).select("snapshot_no", "source")
    runs = df.distinct().select(
        "snapshot_no", "source",
        (F.col("snapshot_no") * 3 + F.expr(_SOURCE_RANK)).cast("bigint").alias("id"),
        (F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(F.col("snapshot_no"))).alias("started_at"),
        F.when(F.col("snapshot_no") < 3, F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(
            F.col("snapshot_no"), F.lit(0), F.lit(5))).alias("finished_at"),
        F.when(F.col("snapshot_no") == 2, F.lit("timeout")).alias("error"))
    return state.run_log(df, runs, ["snapshot_no", "source"])


@register("orphan_price_history", f"""
SELECT listing_id, price, min(observed_at) AS observed_at FROM ({_EVENT_OBS_SQL}) o
WHERE listing_id NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderdate >= DATE '1998-01-01')
GROUP BY listing_id, price""")
def orphan_price_history(spark, sf_dir):
    """Price log rows of event users without an order since 1998."""
    orders = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("date"))
    parents = orders.select(F.col("o_custkey").cast("string").alias("id"))
    return state.orphans(state.first_seen_prices(_event_observations(spark, sf_dir)), "listing_id", parents, "id")


# --------------------------------------------------------------------------
# Text sources: documents, conversations, pages, model answers
# (A8-A12, A16, A17, H3, G3 on posts)
# --------------------------------------------------------------------------


def _documents(spark, sf_dir) -> DataFrame:
    return rebalance(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@register("enrich_documents", parse_text_sql("documents", "''", "text", ["doc_id"]))
def enrich_documents(spark, sf_dir):
    """All 37 derived columns over every whole document text."""
    docs = _documents(spark, sf_dir).withColumn("title", F.lit(""))
    return parse_text(docs, "title", "text", keep=["doc_id"])


@register("clean_documents", f"SELECT doc_id, {clean_text(DUCK, 'text')} AS text FROM documents")
def clean_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    from rentgrid.functions.dialect import SPARK
    return docs.select("doc_id", clean_text(SPARK, F.col("text")).alias("text"))


_STRIP_SQL = DUCK.strip("piece")


@register("split_dumps", f"""
SELECT doc_id, pos, length(post) AS post_chars FROM (
  SELECT doc_id, pos, {DUCK.strip('piece')} AS post FROM (
    SELECT doc_id, unnest(string_split(text, '{P.DUMP_SEPARATOR}')) AS piece,
           unnest(range(len(string_split(text, '{P.DUMP_SEPARATOR}')))) AS pos FROM documents) s) t
WHERE length(post) > 0""")
def split_dumps(spark, sf_dir):
    out = posts.split_dumps(_documents(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.length("post").alias("post_chars"))


def _conversation_posts(spark, sf_dir) -> DataFrame:
    conv = rebalance(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return posts.normalize_posts(conv, "text")


_NORMALIZED_POSTS_SQL = ("SELECT conv_id, turn, " +
                         DUCK.strip(DUCK.regexp_replace("text", P.POST_NEWLINES_PATTERN, "\n\n")) +
                         " AS text FROM conversations")


@register("normalize_posts", f"SELECT conv_id, turn, text FROM ({_NORMALIZED_POSTS_SQL}) p")
def normalize_posts(spark, sf_dir):
    return _conversation_posts(spark, sf_dir).select("conv_id", "turn", "text")


@register("extraction_candidates", f"""
SELECT conv_id, turn, length(text) AS chars FROM ({_NORMALIZED_POSTS_SQL}) p
WHERE length({DUCK.strip('text')}) >= {P.MIN_POST_CHARS}""")
def extraction_candidates(spark, sf_dir):
    cand = posts.extraction_candidates(_conversation_posts(spark, sf_dir), "text")
    return cand.select("conv_id", "turn", F.length("text").alias("chars"))


# posts as captured: the turn's text, its role as author, links and images by position
@register("post_records", f"""
SELECT conv_id, turn, {DUCK.strip(DUCK.regexp_replace("text", P.POST_NEWLINES_PATTERN, chr(10) * 2))} AS text, role AS author,
       CASE WHEN turn % 3 = 0 THEN '' ELSE '/groups/x/posts/' || turn END AS post_url,
       CASE WHEN turn % 2 = 0 THEN 'https://scontent.example/' || turn || '.jpg' ELSE '' END AS images
FROM conversations""")
def post_records(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    link = F.when(F.col("turn") % 3 == 0, F.lit("/groups/x/about")).otherwise(F.concat(F.lit("/groups/x/posts/"), turn))
    image = lambda src, width: F.struct(src.alias("src"), width.alias("width"))
    scontent = F.concat(F.lit("https://scontent.example/"), turn, F.lit(".jpg"))
    images = F.array(
        image(scontent, F.when(F.col("turn") % 2 == 0, F.lit("320")).otherwise(F.lit("100"))),
        image(F.lit("https://scontent.example/emoji.png"), F.lit("500")),
        image(F.lit("https://other.example/a.jpg"), F.lit("500")), image(scontent, F.lit("wide")))
    raw = conv.select("conv_id", "turn", F.struct("conv_id", "turn").alias("seq"), "text", F.col("role").alias("author"),
                      F.lit(" 2 h ").alias("timestamp_text"), F.array(F.lit("/groups/x"), link).alias("links"),
                      images.alias("images"), F.lit(AS_OF).cast("timestamp").alias("extracted_at"))
    out = posts.post_records(raw)
    return out.select("seq.conv_id", "seq.turn", "text", "author", "post_url",
                      F.array_join("image_urls", "|").alias("images"))


@register("dedup_conversation_posts", f"""
SELECT conv_id, turn FROM ({_NORMALIZED_POSTS_SQL}) p WHERE length(text) > 0
QUALIFY row_number() OVER (PARTITION BY substr(text, 1, {P.POST_DEDUP_PREFIX_CHARS}) ORDER BY conv_id, turn) = 1""")
def dedup_conversation_posts(spark, sf_dir):
    p = _conversation_posts(spark, sf_dir).withColumn("_pos", F.struct("conv_id", "turn"))
    return dedup.first_posts_of_key(p, "text", "_pos", P.POST_DEDUP_PREFIX_CHARS).select("conv_id", "turn")


def _answers_sql() -> str:
    d = DUCK
    t = d.strip("answer")
    lines = f"string_split({t}, chr(10))"
    body = (f"CASE WHEN starts_with({t}, '```') THEN CASE WHEN len({lines}) > 2 "
            f"THEN array_to_string(({lines})[2:len({lines}) - 1], chr(10)) ELSE '' END ELSE {t} END")
    j = lambda k: f"json_extract_string(body, '$.{k}')"
    title = f"coalesce({j('title')}, 'Facebook listing')"
    location = f"coalesce({j('location')}, '')"
    description = f"coalesce({j('description')}, '')"
    ltype = f"coalesce({j('listing_type')}, 'other')"
    types = ", ".join(f"'{t}'" for t in P.LISTING_TYPES)
    loc_text = f"({location} || ' ' || {title} || ' ' || {description})"
    typed = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}
    keys = [f"{j(n)} AS {n}" if LISTING_TYPES_BY_NAME[n] == "string" else
            f"TRY_CAST({j(n)} AS {typed[LISTING_TYPES_BY_NAME[n]]}) AS {n}" for n in ANSWER_KEYS]
    return f"""
WITH a AS ({model_answers_sql()}),
u AS (SELECT listing_key, post_url, {body} AS body FROM a),
v AS (SELECT * FROM u WHERE json_valid(body) AND json_type(body) = 'OBJECT'
      AND coalesce(TRY_CAST(json_extract(body, '$.is_offering') AS BOOLEAN), false))
SELECT listing_key, post_url AS url, 'facebook' AS source, {title} AS title,
       TRY_CAST(json_extract(body, '$.price') AS INTEGER) AS price, {location} AS location,
       {description} AS description,
       CASE WHEN {ltype} IN ({types}) THEN {ltype} ELSE 'other' END AS listing_type,
       TRY_CAST({j('available_date')} AS TIMESTAMP) AS available_date,
       {", ".join(keys)},
       {neighbourhood(d, loc_text)} AS neighbourhood,
       'fb-' || sha256(concat_ws(chr(1), 'facebook', post_url, {title}, {description})) AS id,
       TIMESTAMP '{AS_OF}' AS extracted_at, '' AS image_urls, CAST(NULL AS DOUBLE) AS latitude,
       CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS TIMESTAMP) AS posted_date, CAST(NULL AS INTEGER) AS square_feet
FROM v"""


@register("decode_model_answers", with_ctes(_answers_sql(), "listing_raw"))
def decode_model_answers(spark, sf_dir):
    out = posts.decode_answers(model_answers(spark, sf_dir), "listing_key", "answer", "post_url",
                               F.lit(AS_OF).cast("timestamp"))
    return out.withColumn("image_urls", F.array_join("image_urls", "|"))


@register("page_fields", r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
       len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links,
       length(html) AS html_chars FROM pages""")
def page_fields(spark, sf_dir):
    pages = rebalance(read_table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id",
                        F.regexp_extract("html", r'<title>([^<]*)</title>', 1).alias("title"),
                        F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"),
                        F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("links"),
                        F.length("html").alias("html_chars"))


def _summary(df: DataFrame) -> DataFrame:
    price = F.when(F.coalesce(F.col("price"), F.lit(0)) != 0,
                   F.concat(F.lit("$"), F.col("price").cast("string"), F.lit("/mo"))).otherwise(F.lit("Price N/A"))
    loc = F.when(F.coalesce(F.col("location"), F.lit("")) != "", F.col("location")).otherwise(F.lit("Location N/A"))
    return df.select("listing_key", F.concat(F.lit("["), F.col("source"), F.lit("] "), price, F.lit(" - "),
                                             F.substring(F.coalesce(F.col("title"), F.lit("")), 1, 60),
                                             F.lit(" ("), loc, F.lit(")")).alias("summary"))


@register("listing_summary", with_ctes("""
SELECT listing_key, '[' || source || '] ' ||
       CASE WHEN coalesce(price, 0) <> 0 THEN '$' || CAST(price AS VARCHAR) || '/mo' ELSE 'Price N/A' END ||
       ' - ' || substr(coalesce(title, ''), 1, 60) || ' (' ||
       CASE WHEN coalesce(location, '') <> '' THEN location ELSE 'Location N/A' END || ')' AS summary
FROM listings""", "listings"))
def listing_summary(spark, sf_dir):
    return _summary(listings(spark, sf_dir))


_JSON_FIELDS = ("id", "source", "title", "price", "latitude", "posted_date", "furnished", "image_urls", "vibe")


@register("listing_json", with_ctes("""
SELECT listing_key, 55 AS n_keys, id, source, title, CAST(price AS VARCHAR) AS price, CAST(latitude AS VARCHAR) AS latitude,
       strftime(posted_date, '%Y-%m-%dT%H:%M:%S.%f') AS posted_date, CAST(furnished AS VARCHAR) AS furnished,
       '[' || array_to_string(list_transform(image_urls, lambda u: '"' || u || '"'), ',') || ']' AS image_urls, vibe
FROM enriched""", "enriched"))
def listing_json(spark, sf_dir):
    """Serialised listings (enum text, ISO timestamps, nulls kept), read back
    key by key, as the JSON text itself differs by engine."""
    text = snapshots.to_json_lines(enriched(spark, sf_dir), keep=["listing_key"])
    # one reading of the text for all of its fields, and one for its keys
    return text.select("listing_key", F.size(F.json_object_keys("json")).alias("n_keys"),
                       F.json_tuple("json", *_JSON_FIELDS).alias(*_JSON_FIELDS))


# --------------------------------------------------------------------------
# Market views (K1-K6), no pair generation
# --------------------------------------------------------------------------

_DUP_KEY_SQL = ("concat_ws('|', trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')), "
                "CAST(price AS VARCHAR), coalesce(neighbourhood, ''))")


@register("duplicate_groups", with_ctes(f"""
SELECT {_DUP_KEY_SQL} AS dup_key, count(*) AS listings, count(DISTINCT source) AS sources, min(id) AS first_id
FROM enriched WHERE price IS NOT NULL AND length(title) > 0
GROUP BY 1 HAVING count(DISTINCT source) > 1""", "enriched"))
def duplicate_groups(spark, sf_dir):
    return market.duplicate_groups(enriched(spark, sf_dir).select("id", "source", "title", "price", "neighbourhood"))


_CANON_COLS = ["title", "price", "location", "neighbourhood", "furnished", "pets_allowed"]


@register("canonical_listings", with_ctes(f"""
SELECT {_DUP_KEY_SQL} AS dup_key,
       {', '.join(f"arg_min({c}, CASE WHEN {c} IS NOT NULL THEN ({_SOURCE_RANK}, id) END) AS {c}" for c in _CANON_COLS)}
FROM enriched GROUP BY 1""", "enriched"))
def canonical_listings(spark, sf_dir):
    df = enriched(spark, sf_dir).select("id", "source", *_CANON_COLS)
    return market.canonical_listings(df, _CANON_COLS)


@register("comparables", with_ctes("""
WITH pr AS (SELECT *, CAST(floor(square_feet / 100) AS INTEGER) AS size_band FROM enriched
            WHERE price IS NOT NULL AND price <> 0),
g AS (SELECT listing_type, neighbourhood, size_band, count(*) AS group_listings,
             round(avg(price), 2) AS group_avg_price FROM pr GROUP BY ALL)
SELECT pr.id, pr.listing_key, pr.listing_type, pr.neighbourhood, pr.size_band, pr.price, g.group_listings,
       g.group_avg_price, round(pr.price - g.group_avg_price, 2) AS vs_group
FROM pr LEFT JOIN g ON pr.listing_type IS NOT DISTINCT FROM g.listing_type
  AND pr.neighbourhood IS NOT DISTINCT FROM g.neighbourhood AND pr.size_band IS NOT DISTINCT FROM g.size_band""",
                                   "enriched"))
def comparables(spark, sf_dir):
    df = enriched(spark, sf_dir).select("id", "listing_key", "listing_type", "neighbourhood", "square_feet", "price")
    return market.comparables(df)


@register("price_changes", f"""
WITH o AS (SELECT CAST(user_id AS VARCHAR) AS listing_id, event_id, ts AS observed_at,
                  CAST(floor(value) AS INTEGER) AS price FROM events),
l AS (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id) AS previous FROM o)
SELECT listing_id, event_id, observed_at, price, previous FROM l WHERE previous IS NULL OR previous <> price""")
def price_changes(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    obs = ev.select(F.col("user_id").cast("string").alias("listing_id"), "event_id", F.col("ts").alias("observed_at"),
                    F.floor("value").cast("int").alias("price"))
    return market.price_changes(obs, tie="event_id").select("listing_id", "event_id", "observed_at", "price",
                                                             "previous")


@register("rent_percentile", with_ctes("""
WITH pr AS (SELECT id, listing_key, neighbourhood, price FROM enriched WHERE price IS NOT NULL AND price <> 0),
h AS (SELECT neighbourhood, price, count(*) AS c FROM pr GROUP BY ALL),
b AS (SELECT neighbourhood, price,
             coalesce(sum(c) OVER (PARTITION BY neighbourhood ORDER BY price
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(c) OVER (PARTITION BY neighbourhood) AS n FROM h)
SELECT pr.id, pr.listing_key, pr.neighbourhood, pr.price, round(b.below / b.n, 4) AS cheaper_share
FROM pr LEFT JOIN b ON pr.neighbourhood IS NOT DISTINCT FROM b.neighbourhood AND pr.price = b.price""",
                                       "enriched"))
def rent_percentile(spark, sf_dir):
    return market.rent_percentile(enriched(spark, sf_dir).select("id", "listing_key", "neighbourhood", "price"))


# --------------------------------------------------------------------------
# JSON-LD search pages (A1, A2)
# --------------------------------------------------------------------------


def _jsonld_sql() -> str:
    d = DUCK
    url = _C.absolute_url(d, "href", P.CRAIGSLIST_BASE_URL)
    typ = _C.classify_listing_type(d, "lower(title_text || ' ' || description_text)", "'room_private'",
                                   P.LISTING_TYPE_RULES_A)
    filled = ("id", "source", "url", "title", "price", "location", "latitude", "longitude", "description", "posted_date",
              "image_urls", "listing_type")
    typed = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    nulls = ", ".join(f"CAST(NULL AS {typed[t]}) AS {n}" for n, t in LISTING_FIELDS if n not in filled)
    return f"""
WITH c AS (SELECT *, CAST(floor(listing_key / {jsonld.ITEMS_PER_PAGE}) AS BIGINT) AS page_id,
                  {url} AS url FROM listing_raw WHERE source = 'craigslist'),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY listing_key) - 1 AS INTEGER) AS pos FROM c)
SELECT page_id, pos, 'cl-' || regexp_extract(url, '/(\\d+)\\.html', 1) AS id, 'craigslist' AS source, url,
       title_text AS title, {_extract_price(d, "price_text")} AS price,
       concat_ws(', ', NULLIF(location_text, ''), 'BC') AS location,
       CASE WHEN lat_text <> '' THEN TRY_CAST(lat_text AS DOUBLE) END AS latitude,
       CASE WHEN lat_text = '' OR TRY_CAST(lat_text AS DOUBLE) IS NOT NULL
            THEN TRY_CAST(NULLIF(lon_text, '') AS DOUBLE) END AS longitude,
       description_text AS description, CASE date_attr WHEN '20261119' THEN TIMESTAMP '2026-11-19' WHEN '2026-11-22' THEN TIMESTAMP '2026-11-22'
         WHEN '20261120T101500' THEN TIMESTAMP '2026-11-20 10:15:00' WHEN '20261120T1015' THEN TIMESTAMP '2026-11-20 10:15:00'
         ELSE CASE WHEN length(date_attr) > 15 THEN TRY_CAST(date_attr AS TIMESTAMP) END END AS posted_date,
       array_to_string(list_filter(string_split(images_text, '|'), lambda s: starts_with(s, 'http')), '|')
         AS image_urls,
       {typ} AS listing_type, {nulls}
FROM p WHERE page_id % 5 <> 4 AND title_text <> ''
UNION ALL BY NAME
SELECT page_id, pos, l.id, 'craigslist' AS source, l.url, l.title, l.price, l.location, CAST(NULL AS DOUBLE) AS latitude,
       CAST(NULL AS DOUBLE) AS longitude, '' AS description, l.posted_date, '' AS image_urls, 'room_private' AS listing_type, {nulls}
FROM p JOIN listings l USING (listing_key) WHERE page_id % 5 = 4"""


@register("decode_jsonld_pages", with_ctes(_jsonld_sql(), "listings"))
def decode_jsonld_pages(spark, sf_dir):
    """Search pages with JSON and cards; each fifth page's JSON is broken, so its cards are read."""
    raw = listing_raw(spark, sf_dir).filter(F.col("source") == "craigslist")
    cards = site_pages.encode_cards(raw, "craigslist", jsonld.ITEMS_PER_PAGE)
    pages = jsonld.encode_pages(raw).join(cards, "page_id").select(
        "page_id", F.replace("html", F.lit("</body>"), F.concat(F.lit("<ol>"), "cards", F.lit("</ol></body>"))).alias("html"))
    out = search_cards.decode_search_pages(pages, AS_OF)
    return out.withColumn("image_urls", F.array_join("image_urls", "|"))


# --------------------------------------------------------------------------
# Cards and detail pages from raw HTML
# --------------------------------------------------------------------------
_CARDS_PER_PAGE = 50


@register("decode_kijiji_cards", with_ctes(f"""
WITH p AS (SELECT listing_key, CAST(floor(listing_key / {_CARDS_PER_PAGE}) AS BIGINT) AS page_id, string_split(images_text, '|')[1] AS image
           FROM listing_raw WHERE source = 'kijiji'),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY listing_key) - 1 AS INTEGER) AS pos FROM p)
SELECT page_id, pos, id, url, title, price, location, description, posted_date, listing_type,
       CASE WHEN starts_with(image, 'http') THEN image ELSE '' END AS image_urls
FROM n JOIN listings USING (listing_key)""", "listings"))
def decode_kijiji_cards(spark, sf_dir):
    """Result cards of the second site, read from their HTML."""
    raw = listing_raw(spark, sf_dir).filter(F.col("source") == "kijiji")
    cards = site_pages.encode_cards(raw, "kijiji", _CARDS_PER_PAGE)
    pages = cards.select("page_id", F.concat(F.lit("<html><body><ul>"), "cards", F.lit("</ul></body></html>")).alias("html"))
    out = site_pages.decode_cards(pages, "kijiji", AS_OF)
    return out.select("page_id", "pos", "id", "url", "title", "price", "location", "description", "posted_date", "listing_type",
                      F.array_join("image_urls", "|").alias("image_urls"))


def _details_sql() -> str:
    d, attrs, images = DUCK, "string_split(attrs_text, '|')", "string_split(images_text, '|')"
    lat, lon = _C.coordinates(d, "lat_text", "lon_text")
    parts = []
    for site in ("craigslist", "kijiji"):
        first = site == "craigslist"
        flags = (_C.craigslist_attr_flags if first else _C.kijiji_attr_flags)(d, attrs)
        text = _C.strip_qr_boilerplate(d, "description_text") if first else "description_text"
        parts.append(f"""SELECT listing_key, href AS url, {clean_text(d, text)} AS description,
       array_to_string({_C.http_images(d, images, drop_placeholder=not first)}, '|') AS image_urls, {lat} AS latitude, {lon} AS longitude,
       {", ".join(f"{e} AS {c}" for c, e in flags.items())} FROM listing_raw WHERE source = '{site}'""")
    return "\nUNION ALL BY NAME\n".join(parts)


@register("decode_detail_pages", with_ctes(_details_sql(), "listing_raw"))
def decode_detail_pages(spark, sf_dir):
    """Detail pages of both sites, read from their HTML."""
    raw = listing_raw(spark, sf_dir)
    sites = [site_pages.decode_details(site_pages.encode_details(raw.filter(F.col("source") == s), s), s, keep=("listing_key",))
             for s in ("craigslist", "kijiji")]
    out = sites[0].unionByName(sites[1])
    return out.withColumn("image_urls", F.array_join("image_urls", "|"))


# --------------------------------------------------------------------------
# Detail pages joined to cards
# --------------------------------------------------------------------------


_CARD_FLAGS = ", ".join(f"CASE WHEN d.{c} THEN TRUE ELSE CAST(NULL AS BOOLEAN) END AS {c}" for c in _details.FLAG_COLUMNS)
_CARD_PLAIN = ", ".join(f"c.{c}" for c in _details.CARD_COLUMNS if c != "listing_type")


# cards show 40 characters and one image; every fifth capture has no page
@register("attach_details", with_ctes(f"""
WITH d AS (SELECT * FROM listings WHERE url <> '' AND listing_key % 5 <> 0
           QUALIFY row_number() OVER (PARTITION BY url ORDER BY snapshot_no DESC, listing_key DESC) = 1),
j AS (SELECT {_CARD_PLAIN}, c.listing_type AS card_type, d.url IS NOT NULL AS has_page,
             coalesce(d.description, substr(c.description, 1, 40)) AS description,
             c.image_urls[1:1] AS card_images, d.image_urls AS page_images, d.latitude, d.longitude, d.square_feet, {_CARD_FLAGS}
      FROM listings c LEFT JOIN d ON c.url = d.url)
SELECT * EXCLUDE (card_type, has_page, card_images, page_images),
       array_to_string(CASE WHEN has_page AND source = 'craigslist' THEN list_concat(card_images, page_images)
                            WHEN has_page THEN page_images ELSE card_images END, '|') AS image_urls,
       CASE WHEN has_page AND source = 'craigslist' THEN {_C.classify_listing_type(
           DUCK, "lower(title || ' ' || description)", "card_type", P.LISTING_TYPE_RULES_A)}
            ELSE card_type END AS listing_type
FROM j""", "listings"))
def attach_details(spark, sf_dir):
    captured = listings(spark, sf_dir)
    nothing = {c: F.lit(None).cast(captured.schema[c].dataType) for c in _details.DETAIL_COLUMNS}
    cards = captured.withColumns(nothing | {"description": F.substring("description", 1, 40),
                                            "image_urls": F.slice("image_urls", 1, 1)})
    details = _details.latest_details(captured.filter(F.col("listing_key") % 5 != 0), ["snapshot_no", "listing_key"])
    out = _details.attach_details(cards, details)
    return out.withColumn("image_urls", F.array_join("image_urls", "|"))


# --------------------------------------------------------------------------
# Source selection (A19) and first posts
# --------------------------------------------------------------------------

_SOURCE_SPEC = " craigslist, kijiji ,, nosuch "


@register("select_sources", with_ctes(f"""
SELECT listing_key, source, id FROM listings
WHERE source IN ({', '.join(repr(s) for s in _registry.source_names(_SOURCE_SPEC, warn=False))})""", "listings"))
def select_sources(spark, sf_dir):
    return _registry.select_sources(listings(spark, sf_dir), _SOURCE_SPEC).select("listing_key", "source", "id")


@register("first_posts", f"""
SELECT conv_id, turn FROM ({_NORMALIZED_POSTS_SQL}) p ORDER BY conv_id, turn LIMIT 50""")
def first_posts(spark, sf_dir):
    p = _conversation_posts(spark, sf_dir).withColumn("_pos", F.struct("conv_id", "turn"))
    return query.first_posts(p, 50, "_pos").select("conv_id", "turn")


@register("html_page_fields")
def html_page_fields(spark, sf_dir):
    """Title (entities decoded), links and visible text size of every page,
    read with the standard HTML parser in Arrow batches (rows-only check:
    SQL has no HTML entity decoding)."""
    from rentgrid.sources.html_fields import html_fields
    return html_fields(rebalance(read_table(spark, sf_dir, "pages"), "page_id"))
