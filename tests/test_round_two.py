"""Restarts in new processes, snapshot order, bucketed state, decoders."""

import datetime as dt
import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from rentgrid.operators import dedup, state
from rentgrid.schema import LISTING_COLUMNS, LISTING_FIELDS, STATE_COLUMNS_BY_NAME, as_listings
from rentgrid.sources import jsonld, posts
from rentgrid.sources import snapshots as S

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listing_rows(spark, rows):
    schema = ", ".join(f"{n} {t}" for n, t in LISTING_FIELDS)
    return spark.createDataFrame([tuple(r.get(n) for n in LISTING_COLUMNS) for r in rows], schema)


def run_process(code):
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=240, capture_output=True)


def test_newer_snapshot_wins_whatever_its_files(spark, tmp_path):
    prefix, store = str(tmp_path / "in"), str(tmp_path / "store")
    one = dict(id="a", source="kijiji", title="t", price=1000, extracted_at=dt.datetime(2026, 1, 1))
    two = dict(one, price=2000, extracted_at=dt.datetime(2026, 1, 2), description="x" * 100_000)
    S.write_snapshot(listing_rows(spark, [one]), prefix, dt.datetime(2026, 1, 1))
    S.write_snapshot(listing_rows(spark, [two] + [dict(two, id=f"z{i}") for i in range(20)]), prefix, dt.datetime(2026, 1, 2))
    from rentgrid.streaming.snapshot_stream import start
    start(spark, prefix, store, str(tmp_path / "cp")).awaitTermination(200)
    held = state.ListingStore(spark, store)
    assert held.listings().where("id = 'a'").first().price == 2000
    assert sorted(r.price for r in held.log("price_history").where("listing_id = 'a'").collect()) == [1000, 2000]
    assert held.log("scrape_runs").count() == 2  # one run a snapshot


def test_retried_write_leaves_one_copy_and_latest_reads_one_folder(spark, tmp_path):
    prefix = str(tmp_path)
    rows = listing_rows(spark, [dict(id="a", source="kijiji", title="t")])
    for _ in range(2):
        S.write_snapshot(rows, prefix, dt.datetime(2026, 1, 1, 8))
    S.write_snapshot(rows, prefix, dt.datetime(2026, 1, 2, 8))
    assert S.read_snapshots(spark, prefix).count() == 2
    newest = S.read_latest(spark, prefix)
    assert newest.count() == 1 and all("date=2026-01-02" in f for f in newest.inputFiles()) or newest.first().date == "2026-01-02"


def test_array_snapshots(spark, tmp_path):
    os.makedirs(tmp_path / "2026-11-20")
    (tmp_path / "2026-11-20" / "081500.json").write_text(json.dumps(
        [{"id": "a", "title": "one", "price": 5, "extracted_at": "2026-11-20T08:15:00"}, {"id": "b", "image_urls": ["x"]}], indent=2))
    got = S.read_array_snapshots(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.id, r.price, r.date, r.time) for r in got] == [("a", 5, "2026-11-20", "081500"), ("b", None, "2026-11-20", "081500")]
    assert got[0].extracted_at == dt.datetime(2026, 11, 20, 8, 15)


def test_posts_once_over_two_processes(tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    code = f"""
import sys, datetime as dt
from rentgrid.session import get_spark
from rentgrid.streaming.post_stream import start
spark = get_spark('local[2]', shuffle_partitions=2)
n = int(sys.argv[1]) if len(sys.argv) > 1 else NUMBER
spark.createDataFrame([(n, 'post %d' % n, dt.datetime(2026, 1, 1)), (10 + n, 'shared post', dt.datetime(2026, 1, 1))],
                      'seq long, text string, extracted_at timestamp').coalesce(1).write.mode('append').json({src!r})
start(spark, {src!r}, {out!r}, {cp!r}).awaitTermination(200)
"""
    for n in (1, 2):
        run_process(code.replace("NUMBER", str(n)))
    import glob

    import pyarrow.parquet as pq
    seqs = sorted(x for f in glob.glob(f"{out}/posts/batch=*/*.parquet") for x in pq.ParquetFile(f).read()["seq"].to_pylist())
    assert seqs == [1, 2, 11]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    held = state.ListingStore(spark, str(tmp_path), buckets=8)
    kind = ", ".join(f"{n} {t}" for n, t in STATE_COLUMNS_BY_NAME.items())
    runs = spark.createDataFrame([("kijiji", 1, None, None)], "source string, id long, started_at timestamp, finished_at timestamp")

    def batch(ids, price):
        rows = [tuple({"id": i, "source": "kijiji", "title": "t", "price": price}.get(n) for n in STATE_COLUMNS_BY_NAME) for i in ids]
        return spark.createDataFrame(rows, kind).withColumn("seq", F.lit(1))

    held.apply_batch(0, batch([f"i{k}" for k in range(40)], 100), runs, "seq", F.lit(dt.datetime(2026, 1, 1)))
    for _ in range(2):  # a repeated batch gives the same tables
        held.apply_batch(1, batch(["i3"], 200), runs, "seq", F.lit(dt.datetime(2026, 1, 2)))
    assert sorted(held.manifest().values()) == [0] * 7 + [1]
    assert held.listings().count() == 40 and held.listings().where("price = 200").count() == 1
    assert held.log("price_history").count() == 41
    held.apply_batch(2, batch(["i3"], 300), runs, "seq", F.lit(dt.datetime(2026, 1, 3)))
    assert held.retire(keep=1) == 2 and held.listings().count() == 40


def test_older_state_without_a_column(spark):
    kind = ", ".join(f"{n} {t}" for n, t in STATE_COLUMNS_BY_NAME.items())
    row = tuple({"id": "a", "title": "t", "has_views": True}.get(n) for n in STATE_COLUMNS_BY_NAME)
    new = spark.createDataFrame([row], kind).withColumn("seq", F.lit(1))
    old = new.drop("seq", "has_views", "vibe").withColumn("title", F.lit("first"))
    got = state.upsert(old, new, "seq").first()
    assert got.title == "first" and got.has_views is True


def test_run_states(spark):
    runs = spark.createDataFrame([("a", 1, dt.datetime(2026, 1, 1), None), ("b", 2, dt.datetime(2026, 1, 2), None),
                                  ("c", 3, None, "timeout")],
                                 "source string, id long, finished_at timestamp, error string").withColumn("started_at", F.lit(None).cast("timestamp"))
    runs = runs.withColumn("finished_at", F.when(F.col("source") == "a", F.col("finished_at")))
    batch = spark.createDataFrame([("a",), ("a",), ("c",)], "source string")
    got = {r.source: (r.status, r.listings_found) for r in state.run_log(batch, runs).collect()}
    assert got == {"a": ("completed", 2), "b": ("running", 0), "c": ("failed", 0)}


def test_json_ld_script_in_any_attribute_order(spark):
    item = '[{"name": "Room", "url": "https://x.example/1234567.html", "datePosted": "2026-11"}]'
    tags = ['<script type="application/ld+json" id="ld_searchpage_results">', "<script id='ld_searchpage_results'>",
            "<SCRIPT data-id=x id=ld_searchpage_results async>", '<script data-id="ld_searchpage_results">', '<script id="other">']
    pages = spark.createDataFrame([(i, f"<p>x</p><script>1</script>{t}{item}</script>") for i, t in enumerate(tags)],
                                  "page_id long, html string")
    got = jsonld.decode_pages(pages).collect()
    assert sorted(r.page_id for r in got) == [0, 1, 2]
    assert set(LISTING_COLUMNS) <= set(got[0].asDict()) and got[0].posted_date is None


def test_whole_model_answer(spark):
    answer = {"is_offering": True, "title": "Room", "price": 900, "num_bathrooms": 2, "furnished": True, "vibe": "quiet",
              "age_range_max": 30, "has_views": False, "available_date": "20261201", "lease_type": "month_to_month"}
    df = spark.createDataFrame([(1, json.dumps(answer))], "seq long, answer string")
    r = posts.decode_answers(df, "seq", "answer", extracted_at=F.lit(dt.datetime(2026, 1, 1))).first()
    assert (r.num_bathrooms, r.furnished, r.vibe, r.age_range_max, r.has_views, r.lease_type) == (
        2, True, "quiet", 30, False, "month_to_month")
    assert r.available_date == dt.datetime(2026, 12, 1) and r.id.startswith("fb-") and len(r.id) == 67
    assert r.extracted_at == dt.datetime(2026, 1, 1) and set(LISTING_COLUMNS) <= set(r.asDict())


def test_missing_description_keeps_the_title_rules(spark):
    from rentgrid.operators.enrich import enrich
    rows = listing_rows(spark, [dict(id="a", source="kijiji", title="Cats ok, furnished room")])
    assert enrich(rows).first().pets_allowed is True


def test_posts_of_key_move_no_text(spark):
    df = spark.createDataFrame([(2, "same start, other end", "b"), (1, "same start, end", "a"), (3, "", "c")],
                               "seq long, text string, author string")
    out = dedup.first_posts_of_key(df, "text", "seq", 10)
    assert [(r.seq, r.author) for r in out.collect()] == [(1, "a")] and "text" not in out.columns


def test_as_listings_fills_and_orders(spark):
    out = as_listings(spark.createDataFrame([("5", "a")], "price string, id string"))
    assert out.columns == LISTING_COLUMNS and out.first().price == 5


def test_cards_are_read_where_the_json_gives_no_row(spark):
    from rentgrid.sources import search_cards
    tag = '<script id="ld_searchpage_results">'
    cards = """<ul><li class="cl-search-result" data-pid="77"><a class="titlestring" href="/van/1.html">Bright &amp; quiet</a>
<span class="priceinfo">$1,200</span><div class="meta"><span class="nearby">(Kitsilano)</span>
<time datetime="2026-11-02T10:00:00">x</time></div></li><li class="cl-search-result"><span class="price">$5</span></li>
<li class="cl-search-result"><div class="title-blob"><a href="https://x.example/9876543.html">Second<br>room</a></div></li></ul>"""
    pages = spark.createDataFrame([(1, f'{tag}[{{"name": "Json"}}]</script>{cards}'), (2, f"{tag}{{not json</script>{cards}"),
                                   (3, cards), (4, f'{tag}[{{"url": "u"}}]</script>{cards}'), (5, None),
                                   (None, f'{tag}[{{"name": "No page id"}}]</script>{cards}')], "page_id long, html string")
    got = search_cards.decode_search_pages(pages, "2026-11-20 00:00:00").collect()
    assert sorted((str(r.page_id), r.title) for r in got) == sorted(
        [("1", "Json"), ("None", "No page id")] + [(i, t) for i in "234" for t in ("Bright & quiet", "Second room")])
    r = next(r for r in got if r.page_id == 2 and r.pos == 0)
    assert (r.id, r.price, r.location, r.listing_type, r.posted_date) == (
        "cl-77", 1200, "Kitsilano", "room_private", dt.datetime(2026, 11, 2, 10))
    assert r.url.endswith("/van/1.html") and {x.id for x in got if x.title == "Second room"} == {"cl-9876543"}
