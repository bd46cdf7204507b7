"""Market queries over listings, captures and events (K1, K3, K4), posts
through an extractor (A10, J2) and source plug-ins (J1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rentgrid.functions import patterns as P
from rentgrid.functions.dialect import DUCK
from rentgrid.functions.extract import neighbourhood
from rentgrid.operators import constraints, history, matching, nearest, state, summary_view
from rentgrid.operators.graph import Steps, shared_folder
from rentgrid.plans.base import enriched, listings, with_ctes
from rentgrid.plans.catalog import _NORMALIZED_POSTS_SQL, _POSITIONS_SQL, _ordered, register
from rentgrid.session import read_table
from rentgrid.sources import answers
from rentgrid.sources.fixture import AS_OF, listing_raw
from rentgrid.sources.registry import listings_of

# --------------------------------------------------------------------------
# K1: every listing, and two of five again in another source with other words
# and another price, as people repost them.
# --------------------------------------------------------------------------
_REPOSTED_SQL = """
reposted AS (
  SELECT listing_key * 2 AS key, source, title || ' ' || description AS body, price, neighbourhood FROM enriched
  UNION ALL
  SELECT listing_key * 2 + 1, CASE source WHEN 'craigslist' THEN 'kijiji' WHEN 'kijiji' THEN 'facebook' ELSE 'craigslist' END,
         title || ' ' || description || CASE WHEN listing_key % 2 = 0 THEN ' Call today.' ELSE ' Text me any evening, ask for the landlord of unit ' || (listing_key % 50) END,
         price + CAST((listing_key % 4) * 20 AS INTEGER), neighbourhood
  FROM enriched WHERE listing_key % 5 < 2)"""

#: Words of a listing as DuckDB writes them.
_WORDS_SQL = "list_distinct(regexp_extract_all(lower(coalesce(body, '')), '[a-z0-9]+'))"


@register("fuzzy_duplicates", with_ctes(f"""WITH {_REPOSTED_SQL},
w AS (SELECT key, source, price, neighbourhood, {_WORDS_SQL} AS words FROM reposted),
e AS (SELECT x.key AS a, y.key AS b FROM w x JOIN w y
      ON x.neighbourhood IS NOT DISTINCT FROM y.neighbourhood AND y.price BETWEEN x.price - 50 AND x.price + 50 AND x.key <> y.key
      WHERE len(x.words) * 5 >= len(y.words) * 4 AND len(y.words) * 5 >= len(x.words) * 4 AND len(x.words) > 0
        AND len(list_intersect(x.words, y.words)) * 9 >= 4 * (len(x.words) + len(y.words))),
walk AS (SELECT key, key AS seen FROM w),
""" + "".join(f"""r{i} AS (SELECT key, min(seen) AS seen FROM (SELECT key, seen FROM {'walk' if i == 0 else f'r{i - 1}'}
       UNION ALL SELECT e.a, p.seen FROM e JOIN {'walk' if i == 0 else f'r{i - 1}'} p ON p.key = e.b) t GROUP BY key),
""" for i in range(12)) + """
n AS (SELECT a, count(*) AS links FROM e GROUP BY a),
c AS (SELECT w.key, w.source, r11.seen AS class_id, coalesce(n.links, 0) AS links FROM w JOIN r11 USING (key) LEFT JOIN n ON n.a = w.key)
SELECT key, source, class_id, links, count(*) OVER (PARTITION BY class_id) AS class_listings,
       s.class_sources FROM c JOIN (SELECT class_id, count(DISTINCT source) AS class_sources FROM c GROUP BY class_id) s USING (class_id)
""", "enriched"))
def fuzzy_duplicates(spark, sf_dir):
    """Listings that say nearly the same at nearly the same price, across sources."""
    df = enriched(spark, sf_dir).select("listing_key", "source", "title", "description", "price", "neighbourhood")
    body = F.concat("title", F.lit(" "), "description")
    number = F.col("listing_key")
    first = df.select((number * 2).alias("key"), "source", body.alias("body"), "price", "neighbourhood")
    again = df.where(number % 5 < 2).select(
        (number * 2 + 1).alias("key"),
        F.when(F.col("source") == "craigslist", "kijiji").when(F.col("source") == "kijiji", "facebook").otherwise("craigslist").alias("source"),
        F.concat(body, F.when(number % 2 == 0, F.lit(" Call today.")).otherwise(
            F.concat(F.lit(" Text me any evening, ask for the landlord of unit "), (number % 50).cast("string")))).alias("body"),
        (F.col("price") + (number % 4).cast("int") * 20).alias("price"), "neighbourhood")
    return matching.fuzzy_duplicates(first.unionByName(again), "key", F.col("body"))


# --------------------------------------------------------------------------
# K3: sizes vary by listing, as the captures know four of them only
# --------------------------------------------------------------------------
@register("comparable_listings", with_ctes("""WITH
s AS (SELECT listing_key, listing_type, neighbourhood, price, square_feet + CAST(listing_key % 397 AS INTEGER) AS square_feet
      FROM enriched WHERE square_feet IS NOT NULL)
SELECT x.listing_key, CAST(row_number() OVER w AS INTEGER) AS rank, y.listing_key AS comparable,
       abs(y.square_feet - x.square_feet) AS square_feet_gap, x.price, y.price AS comparable_price
FROM s x JOIN s y ON x.listing_type = y.listing_type AND x.neighbourhood IS NOT DISTINCT FROM y.neighbourhood
  AND x.listing_key <> y.listing_key AND y.square_feet BETWEEN x.square_feet - 100 AND x.square_feet + 100
WINDOW w AS (PARTITION BY x.listing_key ORDER BY abs(y.square_feet - x.square_feet), y.listing_key)
QUALIFY row_number() OVER w <= 5""", "enriched"))
def comparable_listings(spark, sf_dir):
    """The five nearest in size of the same type and neighbourhood."""
    df = enriched(spark, sf_dir).select("listing_key", *nearest.PLACE, "price")
    df = df.withColumn("square_feet", F.col("square_feet") + (F.col("listing_key") % 397).cast("int"))
    return nearest.comparable_listings(df, "listing_key")


# --------------------------------------------------------------------------
# K4: events as daily sightings, captures as price observations
# --------------------------------------------------------------------------
@register("market_spells", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
     cal AS (SELECT day, row_number() OVER (ORDER BY day) AS run, lead(day) OVER (ORDER BY day) AS later FROM (SELECT DISTINCT day FROM d) t),
     g AS (SELECT user_id, day, run, later, CASE WHEN lag(run) OVER (PARTITION BY user_id ORDER BY run) = run - 1 THEN 0 ELSE 1 END AS starts
           FROM d JOIN cal USING (day)),
     n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS spell FROM g),
     s AS (SELECT user_id, CAST(spell AS INTEGER) AS spell, min(day) AS posted_on, max(day) AS last_seen_on, arg_max_null(later, run) AS removed_on,
                  count(*) AS snapshots FROM n GROUP BY user_id, n.spell)
SELECT user_id, spell, posted_on, last_seen_on, removed_on, CAST(last_seen_on - posted_on + 1 AS INTEGER) AS days_listed, snapshots,
       spell > 1 AS relisted, CAST(posted_on - lag(last_seen_on) OVER (PARTITION BY user_id ORDER BY spell) AS INTEGER) AS days_away FROM s""")
def market_spells(spark, sf_dir):
    """When each listing (here: user of the event stream) was on the market."""
    return history.market_spells(read_table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts")


@register("price_trend", with_ctes("""WITH
o AS (SELECT id, neighbourhood, price, extracted_at, CAST(extracted_at AS DATE) AS day, listing_key FROM enriched
      WHERE price IS NOT NULL AND price <> 0 AND id IS NOT NULL),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM o), (SELECT max(day) FROM o), INTERVAL 1 DAY)) AS DATE) AS day),
f AS (SELECT *, lead(day) OVER (PARTITION BY id ORDER BY day) AS until FROM (
        SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id, day ORDER BY extracted_at DESC, listing_key DESC) = 1) t),
a AS (SELECT cal.day, f.neighbourhood, f.price FROM cal JOIN f ON f.day <= cal.day AND (f.until IS NULL OR cal.day < f.until)),
q AS (SELECT neighbourhood, day, count(*) AS listings, list_sort(list(price)) AS p FROM a GROUP BY neighbourhood, day),
r AS (SELECT neighbourhood, day, listings, p[CAST(listings // 4 AS BIGINT) + 1] AS p25_price, p[CAST(listings // 2 AS BIGINT) + 1] AS median_price,
             p[CAST(3 * listings // 4 AS BIGINT) + 1] AS p75_price FROM q)
SELECT *, median_price - lag(median_price) OVER (PARTITION BY neighbourhood ORDER BY day) AS median_change FROM r""", "enriched"))
def price_trend(spark, sf_dir):
    """Quartiles of the prices asked in each neighbourhood on each day."""
    df = enriched(spark, sf_dir).select("id", "neighbourhood", "price", "extracted_at", "listing_key")
    return history.price_trend(df, "id", "extracted_at", tie="listing_key")


# --------------------------------------------------------------------------
# Posts through an extractor, which here answers by rule
# --------------------------------------------------------------------------
def _answer_by_rule(batches):
    """An answer for every text, by its length: each seventh is no JSON, each third no offer."""
    for pdf in batches:
        size = pdf["text"].str.len()
        offers = (size % 3 != 0).map({True: "true", False: "false"})
        body = ('{"is_offering": ' + offers + ', "title": "Post of ' + size.astype(str) + '", "price": ' + (500 + size % 1000).astype(str)
                + ', "location": "Kitsilano", "listing_type": "studio"}')
        yield pdf[["digest"]].assign(answer=body.where(size % 7 != 0, "Sorry, no."))


_POST_PLACE = "'Kitsilano Post of ' || n || ' '"


@register("post_listings", f"""
WITH p AS (SELECT conv_id, turn, length(text) AS n FROM ({_NORMALIZED_POSTS_SQL}) t WHERE length({DUCK.strip('text')}) >= {P.MIN_POST_CHARS})
SELECT conv_id, turn, 'Post of ' || n AS title, CAST(500 + n % 1000 AS INTEGER) AS price, 'studio' AS listing_type,
       {neighbourhood(DUCK, _POST_PLACE)} AS neighbourhood FROM p WHERE n % 3 <> 0 AND n % 7 <> 0""")
def post_listings(spark, sf_dir):
    """Every conversation turn as a post, through filter, extractor, answer store and decoder."""
    conv = read_table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("post"), "text")
    store = answers.AnswerStore(spark, f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}")
    out = answers.listings_of_posts(conv, "post", "text", store, _answer_by_rule, parts=4)
    return out.select("post.conv_id", "post.turn", "title", "price", "listing_type", "neighbourhood")


@register("registered_listings", with_ctes("""
SELECT listing_key, id, price, posted_date, neighbourhood FROM enriched WHERE source IN ('kijiji', 'facebook')""", "enriched"))
def registered_listings(spark, sf_dir):
    """Captures of the configured sources, each through its registered decoder."""
    return listings_of(listing_raw(spark, sf_dir), "facebook, kijiji,", AS_OF).select("listing_key", "id", "price", "posted_date", "neighbourhood")


# --------------------------------------------------------------------------
# D1-D7 kept up to date: two batches, the second changes prices
# --------------------------------------------------------------------------
@register("maintained_price_summary", with_ctes("WITH fin AS (SELECT id, arg_max_null(price, seq) AS price, arg_min_null(source, seq) AS source FROM ("
                                                "SELECT *, CAST(snapshot_no AS BIGINT) * 1000000000000 + listing_key AS seq FROM listings) t GROUP BY id),"
                                                + _POSITIONS_SQL.format(g="source, ", gp="source", gb="GROUP BY source", on="b.source = q.source")
                                                .replace("enriched", "fin").strip().removeprefix("WITH"), "listings"))
def maintained_price_summary(spark, sf_dir):
    """Price statistics per source of the stored state, from the view that each batch changed."""
    # a batch is read up to three times and the state twice: both are kept, with the columns that the view reads
    steps = Steps(spark)
    rows = steps.keep(_ordered(listings(spark, sf_dir)).select("id", "source", "price", "snapshot_no", "_seq", state.tie().alias("_tie")))
    view = summary_view.PriceView(spark, f"{shared_folder(spark)}/view-{uuid.uuid4().hex}", ["source"])
    stored = None
    for n, part in enumerate(("snapshot_no < 2", "snapshot_no >= 2")):
        batch = rows.filter(part)
        now = steps.keep(state.upsert(stored, batch, "_seq", columns=["source", "price"]))
        view.apply(n, summary_view.touched(stored, batch), summary_view.touched(now, batch))
        if stored is not None:
            steps.drop(stored)
        stored = now
    steps.drop(rows, stored)
    return view.summary()


# --------------------------------------------------------------------------
# Declared constraints, over listings of which some lost a column,
# have a long id or a run that was never logged
# --------------------------------------------------------------------------
_TEXTS = [c for c in constraints.LISTINGS.lengths if c not in ("id", "source")]


@register("quarantined_listings", with_ctes(f"""WITH
damaged AS (SELECT listing_key, CASE WHEN listing_key % 7 = 0 THEN repeat(id, 8) WHEN listing_key % 17 = 0 THEN NULL ELSE id END AS id,
  CASE WHEN listing_key % 11 = 0 THEN NULL WHEN listing_key % 19 = 0 THEN source || ', a copy of it' ELSE source END AS source,
  CASE WHEN listing_key % 13 = 0 THEN NULL ELSE extracted_at END AS extracted_at,
  CASE WHEN listing_key % 5 > 0 THEN listing_key % 23 END AS scrape_run_id, {", ".join(_TEXTS)} FROM enriched),
runs AS (SELECT DISTINCT listing_key % 23 AS id FROM enriched WHERE listing_key % 23 < 20)
SELECT * FROM (SELECT listing_key, concat_ws('; ', CASE WHEN d.id IS NULL THEN 'id: null' END,
  CASE WHEN source IS NULL THEN 'source: null' END, CASE WHEN extracted_at IS NULL THEN 'extracted_at: null' END,
  {", ".join(f"CASE WHEN length(d.{c}) > {n} THEN '{c}: over {n}' END" for c, n in constraints.LISTINGS.lengths.items())},
  CASE WHEN scrape_run_id IS NOT NULL AND runs.id IS NULL THEN 'scrape_run_id: not in scrape_runs' END) AS broken
  FROM damaged d LEFT JOIN runs ON runs.id = scrape_run_id) t WHERE broken <> ''
""", "enriched"))
def quarantined_listings(spark, sf_dir):
    """Listings that break a declared constraint, with the reasons."""
    df, key = enriched(spark, sf_dir), F.col("listing_key")
    damaged = df.select(
        "listing_key", F.when(key % 7 == 0, F.repeat("id", 8)).when(key % 17 != 0, F.col("id")).alias("id"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 19 == 0, F.concat("source", F.lit(", a copy of it")))
        .otherwise(F.col("source")).alias("source"),
        F.when(key % 13 != 0, F.col("extracted_at")).alias("extracted_at"),
        F.when(key % 5 > 0, key % 23).alias("scrape_run_id"), *_TEXTS)
    runs = listing_raw(spark, sf_dir).select((key % 23).alias("id")).where("id < 20")
    rows = constraints.checked(damaged, constraints.LISTINGS, {"scrape_runs": runs})
    return constraints.rejected(rows).select("listing_key", F.concat_ws("; ", "broken").alias("broken"))
