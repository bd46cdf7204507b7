import collections
import os

from pyspark.sql import functions as F
from rentgrid.llm import dedup_stream, mixing

LOWER = {c: c + 32 for c in range(65, 91)}


def write(df, tmp_path, name="docs.parquet"):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return path


def test_exact_dedup_against_brute_force(spark, make, odd, clash, prose, tmp_path):
    rows = odd + [(i, prose(20, i % 7).upper() if i % 2 else prose(20, i % 7)) for i in range(40)] + [(39, prose(20, 4).upper())]
    path = write(clash(make(rows)), tmp_path)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((i, max(g), len(g), i == max(g)) for t, g in groups.items() for i in g)
    got = sorted(tuple(r)[:4] for r in dedup_stream.exact_dedup(spark, path).collect())
    assert got == want


def test_state_goes_on_with_new_files(spark, make, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    make([(1, "same"), (2, "other")]).write.parquet(path)
    first = {r.digest: (r.group_size, r.keep_id) for r in dedup_stream.digest_state(spark, path, checkpoint=state).collect()}
    make([(3, "SAME")]).write.mode("append").parquet(path)
    second = {r.digest: (r.group_size, r.keep_id, r.locator.id) for r in
              dedup_stream.digest_state(spark, path, checkpoint=state).collect()}
    assert sorted(first.values()) == [(1, 1), (1, 2)]
    assert sorted(second.values()) == [(1, 2, 2), (2, 3, 3)]


def test_colliding_digests_are_told_apart_by_their_bytes(spark, make, tmp_path):
    rows = make([(1, "a"), (2, "b"), (3, "a"), (4, "c")]).withColumn("_norm", F.col("text")).withColumn(
        "_digest", F.when(F.col("text").isin("a", "b"), "h").otherwise("k"))
    state = rows.groupBy(F.col("_digest").alias("digest")).agg(F.count(F.lit(1)).alias("group_size"),
                                                               F.max("doc_id").alias("keep_id"))
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in dedup_stream.exact_classes(rows, state).collect())
    assert got == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]


def test_empty_table_and_single_file(spark, make, tmp_path):
    assert dedup_stream.exact_dedup(spark, write(make([(1, "x")]).limit(0), tmp_path)).count() == 0
    folder = tmp_path / "one"
    make([(1, "x"), (2, "x")]).coalesce(1).write.parquet(str(folder))
    file = next(str(folder / f) for f in os.listdir(folder) if f.endswith(".parquet"))
    assert dedup_stream.exact_dedup(spark, file).where("kept").count() == 1


def fill(sizes, weights, cap):
    """Targets by resharing what is cut until nothing is above."""
    total, target, cut = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set()
    while True:
        left = total - sum(cap * sizes[s] for s in cut)
        free = sum(weights[s] for s in sizes if s not in cut)
        target = {s: cap * sizes[s] if s in cut else left * weights[s] / free for s in sizes}
        above = {s for s in sizes if s not in cut and target[s] > cap * sizes[s]}
        if not above:
            return target
        cut |= above


def test_mix_targets_and_takes(spark, make, odd, clash, prose):
    n = {"a": 30, "b": 12, "c": 3, "d": 25, "e": 1, None: 8}
    rows, i = [(k, t, "a") for k, t in odd], 0
    for s, k in n.items():
        for j in range(k):
            rows.append((i, prose(5 + (j * 7) % 60, i), s))
            i += 1
    rows.append((0, rows[7][1], "a"))  # a repeated row
    docs = clash(make(rows))
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    import re
    sizes, source = collections.Counter(), {}
    for k, t, s in rows:
        sizes[s] += len(re.findall(mixing.WORD, t or ""))
        source[k] = s
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, 3)
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        longest = max(r["size"] for r in got if source[r["doc_id"]] == s)
        assert abs(taken[s] - want[s]) <= longest / 2 + 1
    again = sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mix_without_rows_or_words(spark, make):
    assert mixing.mix(make([(1, "x")]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(make([(1, None), (2, " ")])).collect()] == [0, 0]


def test_knapsack_is_exact_on_small_budgets():
    import itertools
    lengths, counts = [3, 5, 11], [4, 3, 2]
    sums = {sum(a * b for a, b in zip(lengths, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts))}
    for budget in range(1, 50):
        take = mixing._exact(__import__("numpy").array(lengths), __import__("numpy").array(counts), budget)
        nearest = min(sums, key=lambda s: (abs(s - budget), s))
        assert all(take <= counts) and sum(take * lengths) == nearest
        assert sum(mixing.knapsack(lengths, counts, budget) * lengths) == min(
            sums, key=lambda s: (abs(s - min(budget, 49)), s))


def test_knapsack_beyond_the_dynamic_program():
    import numpy as np
    rng = np.random.default_rng(3)
    lengths, counts = np.arange(1, 4000), rng.integers(1, 2000, 3999)
    total = int((lengths * counts).sum())
    for budget in (total // 7, total // 2, total - 1):
        got = mixing.knapsack(lengths, counts, budget)
        assert (got <= counts).all() and int((got * lengths).sum()) == budget
