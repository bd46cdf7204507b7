"""The maintained price statistics against a full recomputation."""

import random

from rentgrid.operators import stats
from rentgrid.operators.summary_view import PriceView, touched


def test_view_equals_recomputation(spark, tmp_path):
    rng = random.Random(3)
    schema = "id string, source string, price int"
    state, view = {}, PriceView(spark, str(tmp_path / "view"), ["source"])
    for batch in range(6):
        rows = {(f"l{rng.randrange(60)}" if rng.random() < .95 else None): (rng.choice("abc") if rng.random() < .9 else None, rng.choice([None, 0, 900, rng.randint(1, 3000)]))
                for _ in range(40)}
        before, after = dict(state), {**state, **rows}
        frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], schema)
        stored = frame(before) if before else None
        view.apply(batch, touched(stored, frame(rows)), touched(frame(after), frame(rows)))
        if batch == 3:  # applied again after a failure
            view.apply(batch, touched(stored, frame(rows)), touched(frame(after), frame(rows)))
        state = after
        for groups in (["source"], []):
            want = sorted(map(str, stats.price_summary(frame(state), groups).collect()))
            assert sorted(map(str, view.summary(groups).collect())) == want
    assert len(view.versions()) <= 4
