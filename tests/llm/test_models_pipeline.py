import corpus_pipeline
import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F
from rentgrid.llm import quality, queries, toxicity
from rentgrid.llm.labelled import held_out, training_sample

SF = "/root/testdata/sf0.01"


def accuracy(spark, out, label):
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select(
        F.col(label).alias("y"), "predicted").collect()
    return [(r.y, r.predicted) for r in rows]


def test_held_out_fold(make):
    rows = [(i, "x") for i in range(30)]
    got = {r.doc_id: r.h for r in make(rows).select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(30)}


def test_sample_uses_no_held_out_or_null_label(spark, make):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = make([(i, None if i == 2 else f"t{i}") for i in range(60)])
    got = training_sample(docs, labels, "toxic").collect()
    assert {r.doc_id for r in got} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert training_sample(docs, labels, "toxic", 7).count() == 7


def test_quality_ranks_held_out_documents(spark):
    pairs = accuracy(spark, queries.QUERIES["op5_quality"](spark, SF), "quality")
    assert sum(y == p for y, p in pairs) >= 0.95 * len(pairs) and any(p == 0 for _, p in pairs)


def test_toxicity_finds_held_out_documents(spark):
    pairs = accuracy(spark, queries.QUERIES["op6_toxicity"](spark, SF), "toxic")
    assert sum(p for y, p in pairs if y == 0) <= 0.02 * len(pairs)
    assert sum(p for y, p in pairs if y) >= 0.6 * sum(y for y, _ in pairs)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_models_on_odd_input(spark, make, odd, clash, module, label):
    labels = spark.createDataFrame([(101, 0), (104, 1), (None, 1), (105, None)], f"doc_id long, {label} int")
    docs = clash(make(odd + odd[:2]))
    for some in (labels, labels.limit(0)):
        out = module.score(docs, module.fit(docs, some)).collect()
        assert len(out) == len(odd) + 2 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        assert len({r.score for r in out if r.doc_id in (101, 102)}) == 1
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_label_model_learns_accuracies_and_joint_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.15
    votes = [rng.random(len(y)) < np.where(y, hit, noise) for hit, noise in ((.8, .02), (.7, .05), (.6, .01), (.9, .1))]
    votes.append(np.where(rng.random(len(y)) < 0.95, votes[0], ~votes[0]))  # nearly a copy of the first
    codes = sum(v.astype(int) << i for i, v in enumerate(votes))
    patterns, inverse, count = np.unique(codes, return_inverse=True, return_counts=True)
    model = toxicity.LabelModel(5)
    posterior = model.fit(patterns, count.astype(float), 5)[inverse]
    assert abs(model.prior - 0.15) < 0.03 and any({0, 4} <= set(c) for c in model.cliques)
    assert ((posterior > 0.5) == y).mean() > 0.96


def test_pairwise_weights_follow_preferences():
    rng = np.random.default_rng(1)
    truth = np.array([2.0, -1.0, 0.0])
    a, b = rng.normal(size=(2, 4000, 3))
    wins = rng.random(4000) < 1 / (1 + np.exp(-(a - b) @ truth))
    w = quality._fit_pairs(np.where(wins[:, None], a - b, b - a))
    assert np.allclose(w, truth, atol=0.25)


def test_pipeline_stages_take_effect(spark, make, prose, tmp_path):
    rows, i = [], 0
    for k in range(40):
        rows.append((i, f"{prose(40, k)} {'you idiot and moron and idiot' if k % 4 == 0 else ''}", f"s{k % 3}"))
        i += 1
    rows += [(100 + k, rows[5][1].upper(), "s0") for k in range(5)]
    rows += [(200 + k, rows[6][1] + f" tail{k}", "s1") for k in range(5)]
    rows += [(300, None, "s0"), (301, "", None), (302, "one", None)]
    sf = str(tmp_path)
    make(rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert set(out.columns) >= set(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    toxic, exact, near, mixed, tokens = kept
    assert toxic == sorted(r[0] for r in rows if not (r[0] < 40 and r[0] % 4 == 0))
    assert exact == [x for x in toxic if x not in (5, 100, 101, 102, 103, 300)]
    assert near == [x for x in exact if not 200 <= x < 205]
    assert set(mixed) <= set(near) and tokens == mixed
    assert max(mixed.count(x) for x in mixed) <= 3
    final = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect())
    assert final == sorted((r.doc_id, r.ids_sha256) for r in docs.select("doc_id", "ids_sha256").collect())


def test_pipeline_stages_keep_rows_apart(spark, make, prose, clash):
    """Repeated rows, one id with several texts, null ids and clashing columns:
    no document is lost, none is multiplied."""
    a, b, c, d = (prose(40, 900 + k) for k in range(4))
    rows = [(1, a, "s0"), (1, b, "s0"), (2, a, "s0"), (2, a, "s0"), (None, c, "s1"), (None, c, "s1"), (None, d, None), (3, b.upper(), "s1"),
            (4, c + " tail", "s0"), (5, None, "s0"), (None, "", "s0"), (6, "few words", "s0")]
    docs = clash(make(rows)).withColumn("_row", F.lit("x")).withColumn("_class", F.lit(1))
    texts = lambda df: [(str(r.doc_id), r.text) for r in df.collect()]
    exact = texts(corpus_pipeline.exact_dedup(spark, docs, ""))
    assert sorted(exact, key=str) == sorted([("2", a), ("3", b.upper()), ("None", c), ("None", d), ("4", c + " tail"), ("5", None), ("6", "few words")], key=str)
    near = texts(corpus_pipeline.near_dedup(spark, docs, ""))
    assert sorted(t or "" for _, t in near) == sorted([a, b, c + " tail", d, "", "", "few words"])
    assert ("1", a) in near and ("1", b) in near
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    many = {t: sum(r.text == t for r in mixed) for t in (a, c, d)}
    assert many[a] <= 9 and many[c] <= 6 and many[d] <= 3
    sizes = {s: sum(len(t.split()) for _, t, s2 in rows if t and s2 == s) for s in ("s0", "s1", None)}
    taken = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in sizes}
    assert all(taken[s] <= 3 * sizes[s] for s in sizes) and sum(taken.values()) >= 0.8 * sum(sizes.values())
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.where("false"), "").count() == 0
