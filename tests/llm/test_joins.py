import random

import numpy as np
import pyarrow as pa
import pytest
from rentgrid.llm import line_dedup, parity_join, quality_rules, suffix_dedup
from rentgrid.llm.components import components

from . import brute


def edited(text, rng, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def family(prose, odd):
    """Texts at all distances, a large group of near copies, a shared passage, and odd ones."""
    rng = random.Random(7)
    base = [prose(n, n) for n in (6, 12, 30, 60, 61, 150, 400)]
    rows = [(i, edited(base[i % 7], rng, rng.randrange(0, 6))) for i in range(70)]
    rows += [(200 + i, edited(base[5], rng, rng.randrange(0, 5))) for i in range(40)]
    passage = prose(25, 99)
    rows += [(300 + i, f"{prose(40 + i, 300 + i)} {passage} {prose(10, 900 + i)}") for i in range(30)]
    rows += [(400 + i, " ".join(base[6].split()[:k])) for i, k in enumerate(range(290, 400, 5))]
    return rows + odd + [(500, "a"), (501, "a b"), (502, "A B"), (503, "x y z w v"), (504, "x y z w v u")]


def test_jaccard_groups(make, clash, family, monkeypatch):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           parity_join.similar_groups(clash(make(family + family[3:5]))).collect()}
    assert got == brute.similar(family)
    assert parity_join.similar_groups(make(family).limit(0)).count() == 0


def test_jaccard_groups_without_frequent_order_and_sent_sides(make, family, monkeypatch):
    monkeypatch.setattr(parity_join, "FREQUENT", 2.0)
    monkeypatch.setattr("rentgrid.llm.tables.SENT_ROWS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_groups(make(family)).collect()}
    assert got == brute.similar(family)


def test_jaccard_groups_by_differences_from_the_central_set(make, family, monkeypatch):
    monkeypatch.setattr(parity_join, "BY_PAIRS", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_groups(make(family)).collect()}
    assert got == brute.similar(family)


def test_texts_too_far_from_their_centre_are_not_compared_with_its_whole_group(make, prose, monkeypatch):
    rng, base = random.Random(12), prose(140, 5)
    rows = [(i, edited(base, rng, rng.randrange(0, 3))) for i in range(60)]
    rows += [(100 + i, edited(base, rng, rng.randrange(6, 8))) for i in range(60)]
    rows += [(200 + i, edited(rows[60 + i][1], rng, 1)) for i in range(5)]
    compared, linked = [], parity_join.Links.linked

    def counted(self, pairs):
        compared.append(pairs.count())
        return linked(self, pairs)

    monkeypatch.setattr(parity_join.Links, "linked", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_groups(make(rows)).collect()}
    assert got == brute.similar(rows)
    assert len({c for _, c in got.values()}) > 20
    assert sum(compared) < 4 * len(rows)


def test_bit_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 200, 60).astype(np.uint64)) for _ in range(2))
        rows = [parity_join._bit_sketch(x, np.zeros(len(x), np.int64), np.arange(1), np.array([128]))[0] for x in (a, b)]
        x, y = (np.frombuffer(r, np.uint8) for r in rows)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    union = brute.Sets({x for e in edges for x in e})
    for a, b in edges:
        union.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.find(x) for x in union.of if union.find(x) != x}


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeated_strings(make, clash, prose, odd, hot):
    rng = random.Random(3)
    shared = [prose(30, k) for k in range(4)]
    rows = [(i, f"{prose(rng.randrange(30), i)} {shared[i % 4][rng.randrange(40):]}{prose(rng.randrange(30), 50 + i)}")
            for i in range(40)]
    rows += [(50, "ab" * 200), (51, "z" * 90), (52, rows[3][1]), (53, rows[3][1]), (53, rows[3][1]), (54, shared[0] * 3)]
    rows += [(r[0], r[1][:2000] if r[1] else r[1]) for r in odd] + [(1, "another text of one key " + shared[1])]
    got = sorted(tuple(r) for r in suffix_dedup.without_repeats(clash(make(rows)), length=60, seed=30, hot=hot).collect())
    assert got == brute.repeated(rows, 60)
    assert suffix_dedup.without_repeats(make(rows).limit(0)).count() == 0


def test_long_texts_are_read_in_parts(make, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rows = [(1, prose(500, 1) + prose(80, 2)), (2, prose(80, 2) + prose(300, 3)), (3, "q" * 2000)]
    got = sorted(tuple(r) for r in suffix_dedup.without_repeats(make(rows), length=60, seed=30).collect())
    assert got == brute.repeated(rows, 60)


def test_suffix_order_and_common_extensions():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    s = suffix_dedup._Suffixes(data, np.cumsum(size) - size, size)
    group = np.sort(np.array([rng.randrange(5) for _ in texts]))
    order = s.order(group)
    want = sorted(range(60), key=lambda i: (group[i], texts[i]))
    assert [(group[i], texts[i]) for i in order] == [(group[i], texts[i]) for i in want]
    common = s.neighbours(order, group)
    for k in range(1, 60):
        a, b = texts[order[k - 1]], texts[order[k]]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        assert common[k] == (n if group[order[k - 1]] == group[order[k]] else -1)


def test_lines(make, clash, prose, odd):
    rng = random.Random(5)
    base = [prose(k, k)[:m] for k, m in ((9, 45), (9, 39), (6, 20), (4, 19), (40, 300), (40, 41))] + ["é漢" * 25]

    def changed(line):
        chars = list(line)
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(chars))
            chars[p:p + rng.randrange(2)] = rng.choice(("", "x", "é"))
        return "".join(chars)

    rows = [(i, "\n".join(rng.choice(("", " ")) + changed(base[rng.randrange(7)]).upper() if rng.random() < .3 else
                          changed(base[rng.randrange(7)]) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [r for r in odd if r[0] != 107] + [(107, "\n\n \n"), (108, "same line\nsame line")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_from, r.kept_sha256) for r in
           line_dedup.dedup_lines(clash(make(rows))).collect()}
    assert got == brute.lines(rows)
    assert line_dedup.dedup_lines(make(rows).limit(0)).count() == 0


def test_edits_grow_with_the_line(make, prose):
    rng = random.Random(9)
    base = [prose(60, 1)[:268], prose(200, 2)[:900], prose(100, 3)[:425]]

    def changed(line, edits):
        chars = list(line)
        for _ in range(edits):
            p = rng.randrange(len(chars))
            chars[p:p + rng.randrange(2)] = rng.choice(("", "x", "é"))
        return "".join(chars)

    rows = [(i, changed(base[0], i)) for i in range(15)]
    rows += [(20 + i, changed(base[1], 12 * i)) for i in range(6)] + [(30 + i, changed(base[2], 5 * i)) for i in range(6)]
    rows += [(40, base[0].replace("river", "a brook", 1).replace("light", "lamp", 1))]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_from, r.kept_sha256) for r in
           line_dedup.dedup_lines(make(rows)).collect()}
    assert got == brute.lines(rows)
    assert all(got[i][1] == 1 for i in (3, 5, 8, 21, 22, 31, 32))


@pytest.mark.parametrize("length", [20, 39, 41, 60, 258, 400, 421, 440, 441, 900])
def test_lines_within_the_threshold_share_an_indexed_piece(length):
    rng = random.Random(length)

    def pieces(line, indexed):
        return {(s, line[p:p + n]) for s, p, n, r in zip(*line_dedup._plan(len(line)), strict=True) if r or not indexed}

    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(length)]
        b, most, kind = list(a), line_dedup.threshold(length), rng.randrange(4)
        for _ in range(most):
            p, size = rng.randrange(len(b) + 1), (0, 1, 0, 1)[kind] if kind < 2 else rng.randrange(2)
            b[p:p + size] = rng.choice(("xy" if kind < 2 else ("x", "")))
        a, b = sorted(("".join(a), "".join(b)), key=len)
        if len(b) - len(a) <= line_dedup.threshold(len(a)) >= line_dedup.edit_distance(a, b, line_dedup.threshold(len(a))):
            assert pieces(a, True) & pieces(b, False)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        for most in (1, 2, 3):
            assert line_dedup.edit_distance(a, b, most) == min(brute.edits(a, b), most + 1)


def test_sketch_bounds_the_edits():
    rng = random.Random(8)
    for _ in range(2000):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 40)))
        b = list(a)
        n = rng.randrange(4)
        for _ in range(n):
            p = rng.randrange(len(b) + 1)
            b[p:p + rng.randrange(2)] = rng.choice(("", "x", "a"))
        bits = np.bitwise_count(line_dedup.sketch(a) ^ line_dedup.sketch("".join(b))).sum()
        assert bits <= line_dedup.BITS_PER_EDIT * n


def test_rules_counts_and_verdict(make, clash, prose, odd, monkeypatch):
    monkeypatch.setattr(quality_rules, "LINE_DOCUMENTS", 3)
    monkeypatch.setattr(quality_rules, "LINE_SHARE", 0.1)
    menu = [prose(12, k) for k in range(3)]
    rows = [(i, "\n".join(menu[:2]) if i < 2 else f"{menu[0].upper()}\n{prose(30, i)}\n{menu[1]}", "h") for i in range(10)]
    rows += [(20 + i, prose(40, 77), "h") for i in range(8)]  # copies count as one document
    rows += [(30 + i, f"{menu[2]}\n{menu[2]}\n### {prose(4, i)}", f"other{i}") for i in range(4)]
    rows += [(50, "w x y z v " * 10, None)] + [(i, t, None) for i, t in odd]
    got = {r.doc_id: r for r in quality_rules.rules(clash(make(rows))).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.counts(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert all(got[i].kept and got[i].n_removed == 0 for i in range(20, 28))
    assert all(got[i].kept and got[i].n_removed == 2 and got[i].words_left == 30 for i in range(2, 10))
    assert [got[i].kept for i in (0, 1)] == [False, False] and got[0].n_removed == 2
    assert quality_rules.rules(make([(1, "x")]).limit(0)).count() == 0


def test_the_line_limit_does_not_loosen_with_the_host(make, prose):
    line = [prose(12, k) for k in range(3)]
    rows = [(i, f"{prose(20, i)}\n{line[0]}" if i < 51 else prose(20, i), "large") for i in range(6000)]
    rows += [(7000 + i, f"{prose(20, 7000 + i)}\n{line[1]}", "small") for i in range(5)]
    rows += [(8000 + i, f"{prose(20, 8000 + i)}\n{line[2]}" if i < 50 else prose(20, 8000 + i), "under") for i in range(200)]
    got = {r.doc_id: r.n_removed for r in quality_rules.rules(make(rows)).collect()}
    assert {i for i, n in got.items() if n} == {*range(51), *range(7000, 7005)}


def test_pairs_verified_together_equal_one_by_one():
    rng = random.Random(8)

    def changed(text, times):
        out = list(text)
        for _ in range(times):
            at = rng.randrange(len(out))
            out[at:at + rng.randrange(2)] = rng.choice(["", "é", "x", "😀b"])
        return "".join(out)
    pairs = []
    for n in [20, 21, 39, 40, 79, 80, 159, 160, 200, 319, 320, 330, 500, 619, 620, 639, 640, 700] * 12:
        a = "".join(rng.choice("ab" if n % 3 else "abcdefgh é😀") for _ in range(n))
        b = changed(a, rng.choice([0, 1, n // 20, n // 20 + 1, n // 12]))
        pairs.append((a, b) if rng.random() < .5 else (b, a))
    limit = [line_dedup.threshold(min(map(len, p))) for p in pairs]
    want = [line_dedup.edit_distance(*p, most) <= most for p, most in zip(pairs, limit, strict=True)]
    got = line_dedup.alike(*([p[k] for p in pairs] for k in range(2)))
    assert got.tolist() == want and 50 < sum(want) < len(want) - 50


def test_unlike_long_lines_are_told_apart_by_counts(monkeypatch):
    """Of few characters, so that their pairs of characters are much the same."""
    rng = random.Random(9)
    words = ["".join(rng.choice("aehnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    lines = [" ".join(rng.choice(words) for _ in range(300))[:1400] for _ in range(30)]
    calls = []
    monkeypatch.setattr(line_dedup, "edit_distance", lambda *a: calls.append(a) or 0)
    assert not line_dedup.alike(lines[:15], lines[15:]).any() and not calls


def test_groups_name_their_least_indexed_line():
    """Lines that share pieces, by entries as the tasks send them."""
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefgh ") for _ in range(200))
    texts = [base[:i] + "x" + base[i + 1:] for i in range(0, 200, 7)] + ["".join(rng.choice("ab") for _ in range(200)) for _ in range(9)]
    lines = pa.RecordBatch.from_arrays([pa.array(range(5, 5 + len(texts)), pa.int64()), pa.array(texts)], ["id", "norm"])
    rows = []
    for blobs in line_dedup._sender(3)([lines]):
        for bucket in sorted(set(blobs["bucket"].to_pylist())):
            rows += [r for b in line_dedup._meet([blobs.filter(pa.array([x == bucket for x in blobs["bucket"].to_pylist()]))]) for r in b.to_pylist()]
    least = {}
    for r in rows:
        if r["indexed"]:
            least[r["gid"]] = min(least.get(r["gid"], r["id"]), r["id"])
    assert len(rows) > 100 and all(r["lead"] == least[r["gid"]] for r in rows)
