"""Fuzzy duplicates, comparables, market intervals and price trend against plain versions."""

import collections
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from rentgrid.operators import history, matching, nearest
from rentgrid.operators.graph import components

WORDS = [f"w{i}" for i in range(40)]


def plain_classes(rows):
    items = [(k, s, set(re.findall("[a-z0-9]+", (t or "").lower())), p, a) for k, s, t, p, a in rows]
    root = {k: k for k, *_ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = collections.Counter()
    for i, (k, _, w, p, a) in enumerate(items):
        for k2, _, w2, p2, a2 in items[i + 1:]:
            if w and w2 and p is not None and p2 is not None and abs(p - p2) <= 50 and a == a2 and 5 * len(w & w2) >= 4 * len(w | w2):
                links[k] += 1
                links[k2] += 1
                x, y = find(k), find(k2)
                root[max(x, y)] = min(x, y)
    size, sources = collections.Counter(find(k) for k in root), collections.defaultdict(set)
    for k, s, *_ in items:
        sources[find(k)].add(s)
    return sorted((k, s, find(k), links[k], size[find(k)], len(sources[find(k)])) for k, s, *_ in items)


def reposts(seed, n, words):
    """Families of near copies of different sizes, in one hot neighbourhood."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base = rng.sample(words, rng.choice([1, 2, 4, 8, 12, 20, 24]))
        price, area = rng.randint(5, 20) * 20, rng.choice(["hot", "hot", "hot", "b", None])
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            if rng.random() < .6:
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < .2:
                w.append(rng.choice(words))
            rng.shuffle(w)
            rows.append((len(rows) * 3 + 1, rng.choice("ckf"), " ".join(w).title() + "!", price + rng.choice([0, 0, 10, 50, 51]), area))
    rows += [(90001, "c", None, 500, "hot"), (90002, "c", "", 500, "hot"), (90003, "k", "no price", None, "hot"), (90004, "k", "no price", None, "hot")]
    return rows


@pytest.mark.parametrize("limit,levels,words", [(100, 4, WORDS), (1, 4, WORDS), (2, 2, WORDS), (1, 8, WORDS[:24])])
def test_fuzzy_duplicates_equal_plain(spark, limit, levels, words):
    rows = reposts(limit * 10 + levels, 150, words)
    df = spark.createDataFrame(rows, "key long, source string, text string, price int, neighbourhood string").repartition(4)
    df = df.withColumn("item", F.lit("clash")).withColumn("words", F.lit(1))
    got = sorted(tuple(r) for r in matching.fuzzy_duplicates(df, "key", F.col("text"), limit=limit, levels=levels).collect())
    want = plain_classes(rows)
    assert got == want
    assert max(r[4] for r in want) > 4


def test_hot_block_is_split(spark):
    """One neighbourhood and price, two words in every text: the largest group
    that is compared stays small, while its links are all found."""
    rng = random.Random(5)
    rows = [(i, "c", " ".join(["rent", "room"] + [f"x{rng.randrange(4000)}" for _ in range(8)]), 1000, "hot") for i in range(1500)]
    rows += [(5000 + i, "k", rows[i][2] + " new", 1010, "hot") for i in range(40)]
    df = spark.createDataFrame(rows, "key long, source string, text string, price int, neighbourhood string")
    out = matching.fuzzy_duplicates(df, "key", F.col("text"), limit=20)
    assert out.where("links > 0").count() == 80 and out.where("class_sources = 2").count() == 80
    base = df.select("key", "source", "price", F.col("neighbourhood").alias("area"), matching.words(F.col("text")).alias("words"))
    entries = matching._entries(matching._items(base), 50, 4, 5, 20, 4)
    assert entries.groupBy("key").count().agg(F.max("count")).first()[0] <= 60
    assert matching.fuzzy_duplicates(df.where("false"), "key", F.col("text")).count() == 0


def test_many_copies_make_no_pairs(spark):
    df = spark.range(20000).select(F.col("id").alias("key"), F.lit("c").alias("source"), F.lit("same words here").alias("text"),
                                   F.lit(900).alias("price"), F.lit("hot").alias("neighbourhood"))
    r = matching.fuzzy_duplicates(df, "key", F.col("text")).groupBy("class_id", "links", "class_listings").count().collect()
    assert [tuple(x) for x in r] == [(0, 19999, 20000, 20000)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (3001, 2000), (2500, 3001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, 3001: 2000, 2500: 2000, 2000: 2000}


def test_comparables_equal_plain(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice(["x", None]), rng.choice([800, 800, 800, rng.randint(300, 1200), None]), rng.choice([None, 900, 1100]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, listing_type string, neighbourhood string, square_feet int, price int").repartition(3)
    got = sorted((tuple(r) for r in nearest.comparable_listings(df, "id", k=3, reach=60).collect()), key=str)
    want = []
    for i, t, a, s, p in rows:
        near = sorted((abs(s2 - s), j, p2) for j, t2, a2, s2, p2 in rows
                      if s is not None and s2 is not None and j != i and t == t2 and a == a2 and abs(s2 - s) <= 60)
        want += [(i, n + 1, j, g, p, p2) for n, (g, j, p2) in enumerate(near[:3])]
    assert got == sorted(want, key=str)


def test_hot_size_needs_no_pairs(spark):
    df = spark.range(30000).select("id", F.lit("a").alias("listing_type"), F.lit("x").alias("neighbourhood"), F.lit(800).alias("square_feet"),
                                   F.col("id").cast("int").alias("price"))
    out = nearest.comparable_listings(df, "id", k=2)
    assert out.count() == 60000 and {r.comparable for r in out.select("comparable").distinct().collect()} == {0, 1, 2}
    assert nearest.comparable_listings(df.where("false"), "id").count() == 0


def test_spells(spark):
    day = lambda n: dt.date(2026, 3, n)
    seen = {"a": [1, 2, 3, 9, 9], "b": [3], "c": [1, 2, 3, 5, 9], None: [2]}
    rows = [(k, day(n)) for k, days in seen.items() for n in days] + [("a", None)] + [("a", day(1))] * 500
    out = history.market_spells(spark.createDataFrame(rows, "id string, day date").repartition(3), "id", "day")
    got = sorted(tuple(r) for r in out.collect())
    # snapshots were taken on the 1st, 2nd, 3rd, 5th and 9th
    assert got == [("a", 1, day(1), day(3), day(5), 3, 3, False, None), ("a", 2, day(9), day(9), None, 1, 1, True, 6),
                   ("b", 1, day(3), day(3), day(5), 1, 1, False, None), ("c", 1, day(1), day(9), None, 9, 5, False, None)]


def test_price_trend_equals_plain(spark):
    rng = random.Random(2)
    start = dt.datetime(2026, 3, 1)
    rows = [(rng.choice(["hot", "hot", "hot"] + [f"l{i}" for i in range(30)]), start + dt.timedelta(hours=rng.randrange(500)),
             rng.choice([None, 0, 900, 1000, 1000, rng.randint(500, 3000)]), rng.choice(["x", "y", None]), i) for i in range(600)]
    rows += [(None, start, 700, "x", 9001), ("l1", None, 700, "x", 9002)]
    df = spark.createDataFrame(rows, "id string, at timestamp, price int, neighbourhood string, n long").repartition(3)
    got = sorted((tuple(r) for r in history.price_trend(df, "id", "at", tie="n").collect()), key=str)
    last, days = collections.defaultdict(dict), set()
    for k, at, p, a, n in rows:
        if k and at and p:
            days.add(at.date())
            last[k].setdefault(at.date(), []).append((at, n, a, p))
    want, before = [], {}
    day = min(days)
    while day <= max(days):
        prices = collections.defaultdict(list)
        for obs in last.values():
            known = [d for d in obs if d <= day]
            if known:
                _, _, a, p = max(obs[max(known)], key=lambda o: o[:2])
                prices[a].append(p)
        for a, p in prices.items():
            p.sort()
            n = len(p)
            # the area's day before, if it had one
            want.append((a, day, n, p[n // 4], p[n // 2], p[3 * n // 4], p[n // 2] - before[a] if a in before else None))
            before[a] = p[n // 2]
        day += dt.timedelta(1)
    assert got == sorted(want, key=str)
