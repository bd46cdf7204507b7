"""A key holding a third of all rows: results stay right and the plans
combine the hot key map-side before any shuffle."""

from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hot(spark, n=30000):
    # one third of the rows share url 'hot' and no id; the rest are unique
    return (spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("id-"), F.col("id").cast("string"))).alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("url"),
        (F.col("id") % 4).cast("int").alias("snapshot_no"),
        F.col("id").alias("listing_key"),
        F.col("id").cast("string").alias("title"),
        F.when(F.col("id") % 3 == 0, F.lit("craigslist")).otherwise(F.lit("kijiji")).alias("source")))


def test_merge_snapshots_hot_key(spark):
    from rentgrid.operators.dedup import merge_snapshots
    out = merge_snapshots(_hot(spark))
    plan = _plan(out)
    assert "partial_max_by" in plan                       # combined before the exchange
    hot = out.filter(F.col("url") == "hot").collect()
    assert len(hot) == 1
    # last snapshot wins (3), then the last row in it
    assert hot[0].snapshot_no == 3 and hot[0].listing_key == max(k for k in range(30000) if k % 3 == 0 and k % 4 == 3)
    assert out.count() == 1 + 20000


def test_dedup_posts_hot_prefix(spark):
    from rentgrid.operators.dedup import dedup_posts
    df = spark.range(30000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.lit("same " * 30))
                                   .otherwise(F.concat(F.lit("post "), F.col("id").cast("string"))).alias("text"))
    out = dedup_posts(df, "text", "seq", 100)
    assert "partial_min_by" in _plan(out)
    assert out.count() == 20001
    assert out.filter(F.col("text").startswith("same")).first().seq == 0


def test_first_per_source_hot_source(spark):
    from rentgrid.operators.query import first_per_source
    out = first_per_source(_hot(spark), 5, ["listing_key"])
    plan = _plan(out)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert out.count() == 10
