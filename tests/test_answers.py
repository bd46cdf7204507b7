"""Posts through an extractor that fails, is retried and gives bad answers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rentgrid.sources.answers import AnswerStore, listings_of_posts

LONG = " and a long enough description of the place, with all that one wants to know" * 2


def extractor(log, broken=()):
    """Notes what it is asked (one file a text) and fails on the broken ones."""
    def run(batches):
        import os
        for pdf in batches:
            for d, t in zip(pdf["digest"], pdf["text"]):
                if any(t.startswith(b) for b in broken):
                    raise RuntimeError("the model is down")
                open(os.path.join(log, f"{d}-{os.urandom(4).hex()}"), "w").close()
            bad = {"bad": "Sorry", "list": "[1]", "none": None}
            yield pd.DataFrame({"digest": pdf["digest"], "answer": [
                bad.get(t.split()[0], f'```json\n{{"is_offering": true, "title": "{t.split()[0]}", "price": 900}}\n```') for t in pdf["text"]]})
    return run


def test_a_retry_asks_only_for_what_is_missing(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    words = ["one", "two", "three", "four", "bad", "list", "none", "one"]
    rows = [(i, w + LONG) for i, w in enumerate(words)] + [(90, "short"), (91, None), (92, "one" + LONG + "\n\n\n\n")]
    df = spark.createDataFrame(rows, "seq long, text string").withColumn("digest", F.lit("clash"))
    store = AnswerStore(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="the model is down"):
        listings_of_posts(df, "seq", "text", store, extractor(str(log), ("three",)), parts=7)
    done = store.answers().count() + store.rejected().count()
    first = len(list(log.iterdir()))
    assert done < 7
    out = listings_of_posts(df, "seq", "text", store, extractor(str(log)), parts=7)
    got = {r.seq: (r.title, r.price) for r in out.collect()}
    assert got == {0: ("one", 900), 1: ("two", 900), 2: ("three", 900), 3: ("four", 900), 7: ("one", 900), 92: ("one", 900)}
    asked = [p.name.split("-")[0] for p in log.iterdir()]
    # a text of a finished part is asked once; only the failed part's texts may be asked again
    assert len(set(asked)) == 7 and len(asked) <= 7 + max(0, first - done)
    assert sorted(r.reason for r in store.rejected().collect()) == ["no answer", "not JSON", "not an object"]
    assert store.ask(df.select(F.sha2("text", 256).alias("digest"), "text").where("seq < 4"), extractor(str(log))) == 0


def test_rejected_answers_can_be_asked_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    df = spark.createDataFrame([("d1", "bad" + LONG)], "digest string, text string")
    store = AnswerStore(spark, str(tmp_path / "store"))
    assert [store.ask(df, extractor(str(log))), store.ask(df, extractor(str(log))), store.ask(df, extractor(str(log)), retry_rejected=True)] == [1, 0, 1]
    assert store.answers().count() == 0 and store.rejected().count() == 1
    assert store.ask(df.where("false"), extractor(str(log))) == 0
