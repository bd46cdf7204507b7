"""Operators 11, 12 and 13 against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from rentgrid.llm import alignment, eigen, queries, url_rules, whitening
from rentgrid.llm.cuts import shared_cuts

# --- eigenvectors ------------------------------------------------------------


def spectrum(values, seed=1):
    n = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(1, 41.0), np.ones(30), [5, 5, 5, 1, 1, 1e-3, 1e-3, 1e-9, 0, 0], 1 + 1e-13 * np.arange(25),
    [1e6] + [1.0] * 20, [3.0], [2.0, 1.0], np.logspace(0, -12, 30)])
def test_leading_eigenvectors(values):
    m = spectrum(values)
    k = min(16, len(m))
    got, axes = eigen.leading(m, k)
    norm = max(values)
    assert np.abs(got - np.sort(values)[::-1][:k]).max() <= 1e-13 * norm * len(m)
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-11
    assert np.abs(m @ axes - axes * got).max() <= 1e-12 * norm * len(m)


def test_eigenvectors_of_diagonal_and_zero():
    got, axes = eigen.leading(np.diag([1.0, 7, 7, 3]), 4)
    assert np.allclose(got, [7, 7, 3, 1]) and np.allclose(axes.T @ axes, np.eye(4))
    got, axes = eigen.leading(np.zeros((3, 3)), 2)
    assert not got.any() and axes.shape == (3, 2)


# --- whitening ---------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def plain_whitening(rows, components=16):
    grid = {}
    for i, (key, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v):
            grid[i] = (key, tuple(int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v))
    fit = sorted({x for _, x in grid.values()})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    z = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for x in fit])
    v = z.T @ z / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    keep = e > 1e-11 * e[0]
    e, axes = e[keep], axes[:, keep]
    out = []
    for key, x in grid.values():
        dev = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        white = np.array([(n * x[j] - s[j]) / n for j in range(d)]) @ axes / np.sqrt(e)
        out.append((key, n, dev, white, e / np.trace(v)))
    return out


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(3)
    scale = np.linspace(1, 4, 20)
    rows = [(i, [float(c) for c in rng.normal(size=20) * scale]) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(7, rows[9][1]), (None, rows[10][1])]
    bad = [(900, None), (901, []), (902, [None] + rows[1][1][1:]), (903, [float("nan")] + rows[1][1][1:]),
           (904, [float("inf")] + rows[1][1][1:]), (905, [1.0, 2.0])]
    got = collections.defaultdict(list)
    for r in whitening.whiten(vectors(spark, rows + bad)).collect():
        got[r.vec_id].append(r)
    plain = plain_whitening(rows)
    assert sorted(map(str, got)) == sorted({str(k) for k, *_ in plain})
    signs = None
    for key, n, dev, white, explained in plain:
        mine = sorted((r for r in got[key]), key=lambda r: r.component)
        by_row = [[r for r in mine if r.deviation == dev]] if key == 7 else [mine]
        for r in by_row:
            r = r[:]
            if key == 7:
                r = sorted(r, key=lambda q: q.component)
            assert {q.n for q in r} == {n} and {q.deviation for q in r} == {dev}
            assert [q.component for q in r] == list(range(1, 17))
            w = np.array([q.whitened for q in r])
            signs = np.sign(w * white) if signs is None else signs
            assert np.allclose(w, signs * white, atol=1e-8)
            assert np.allclose([q.explained for q in r], explained, rtol=1e-9)
            assert max(q.identity_error for q in r) < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (3, [3.0, 2.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in got) == [
        (i, 1, 2, 128 ** 2, 1.0) for i in (1, 2, 3)]


# --- alignment ---------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    return [public_tokenizers.path(n) for n in queries.ALIGNED]


@pytest.fixture(scope="module")
def plain_tokenizers(paths):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def plain_alignment(rows, plain_tokenizers):
    """By the text of the definition: the library's own encoders, sets of ends."""
    first, second = plain_tokenizers
    byte = alignment._byte_of()
    docs, count = [], collections.Counter()
    for key, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            a, b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
            ba = [bytes(byte[c] for c in t) for t in a.tokens]
            bb = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
                  else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ba) == raw == b"".join(bb):
                ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                cuts = sorted(set(ea) & set(eb))
                groups = [([], []) for _ in cuts]
                for ids, ends, side in ((a.ids, ea, 0), (b, eb, 1)):
                    g = 0
                    for i, e in zip(ids, ends):
                        groups[g][side].append(i)
                        g += e == cuts[g]
        pairs = collections.Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        count.update(pairs.keys())
        docs.append((key, groups, pairs))
    best = collections.Counter()
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for key, groups, pairs in docs:
        printed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(pairs.values()),
                    sum(m for p, m in pairs.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in pairs.items()),
                    hashlib.sha256(printed.encode()).hexdigest() if groups else ""))
    return out


ODD_TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tnew\n\nline\r\n", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ already", "naïve É 漢字かな交じり文",
             "👩‍👩‍👧 emoji 🎉🎉", "don't we'll I'M", "x" * 500, "\u0085\u00a0\u3000\u2028mixed\u200bspace", "1234567890 ١٢٣ ½", "aé" * 300,
             "ﬁ ligature Å Å", "\x00\x01 control", "a" + "  \n" * 40 + "b", "y" + " " * 700_000 + "x"]


def test_alignment_equals_plain(spark, make, paths, plain_tokenizers, prose, clash):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, prose(60, i)) for i in range(30)] + [(200 + i, prose(60, 1)) for i in range(5)] + [(100, prose(9, 99)), (None, "no key")]
    rows += [(300, prose(9000, 5))]
    got = [tuple(r) for r in alignment.cross_align(clash(make(rows)), *paths).collect()]
    want = plain_alignment(rows, plain_tokenizers)
    assert sorted(got, key=str) == sorted(want, key=str)
    columns = alignment.cross_align(make([]).where("false"), *paths)
    assert columns.count() == 0


def test_alignment_in_small_slices(spark, make, paths, plain_tokenizers, prose):
    """Slices and parts of a few texts give the same counts."""
    rows = [(i, prose(20, i % 7)) for i in range(60)]
    whole = sorted(tuple(r) for r in alignment.cross_align(make(rows), *paths).collect())
    many = sorted(tuple(r) for r in alignment.cross_align(make(rows), *paths, slice_bytes=300).collect())
    assert whole == many == sorted(plain_alignment(rows, plain_tokenizers))


def test_same_ids_as_the_tokenizer_file(paths, plain_tokenizers):
    """The ranks read from the file give the ids of its own library."""
    tok = alignment.load(*paths)
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(32, 0x250), *range(0x370, 0x600), *range(0x2000, 0x2070), *range(0x3000, 0x3100), 0x1f600, 0x1f468]]
    texts = ["".join(rng.choice(pool[:95] if rng.random() < .7 else pool) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    texts += [" " * n + "x" for n in range(1, 40)] + ["ab" * 3000]
    want = plain_tokenizers[0].encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert all(tok.first.encode_ordinary(" " + t) == w.ids for t, w in zip(texts, want))


def test_shared_cuts_without_any_inside():
    """Long cutless intervals, and common ends far from the middle."""
    a, b = np.arange(2, 4002, 2), np.append(np.arange(1, 4000, 2), 4000)
    got = shared_cuts(a, b, np.array([2000]), np.array([2001]))
    assert [x.tolist() for x in got] == [[2000], [2001]]
    rng = np.random.default_rng(2)
    for p in (.02, .2, .7):
        a, b = (np.flatnonzero(np.append(rng.random(5000) < p, True)) + 1 for _ in range(2))
        cut_a, cut_b = shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[cut_a - 1].tolist() == both == b[cut_b - 1].tolist()


# --- url rules ---------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "https://net", "https://net/", "https://a.NET/x", "https://x.net?q=/", "https://internet/", "http://example.net/en/1",
        "http://www.example.net/en", "http://WWW.Example.Net/en/?a#b", "http://example.net/EN/1", "https://myexample.net/en/1", "https://example.com/de/a",
        "https://x.example.com/fr/", "ftp://a.org/fr/x", "ftp://a.org/fr", "://org/fr/", "http://a://b.net/", "http://ads-track.example.com/en/1", "http://my-ads-track.com/",
        "http://x.org/a/affiliate/b", "http://x.org/affiliate", "http://x.org/doubleclick", "http://x.org/doubleclick.js", "http://x.org/doubleclick/1",
        "http://x.org/doubleclick\n", "http://adserver7.x.org/a.b", "http://user@net:80/", "http://x.net\n/", "http://x.net/" + "a-" * 5000, "http://É.net/é", "a://b.net/", "a://b.net/"]


def plain_rule(pattern):
    """The documented syntax, one character at a time."""
    head = r"\A"
    if pattern.startswith("||"):
        head, pattern = r"\A(?:[^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        pattern = pattern[1:]
    else:
        head = ""
    end = pattern.endswith("|")
    body = "".join(".*" if c == "*" else r"(?:[^a-zA-Z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in (pattern[:-1] if end else pattern))
    return re.compile(head + body + (r"\Z" if end else ""), re.S)


def test_url_rules_equal_plain(spark):
    listed = [("||net/", "block", 1), ("||example.net/en/", "allow", 1), ("||example.com/de/", "block", 1), ("||org/fr/", "allow", 1),
              ("affil*/b|", "block", 0), ("|x.org/aff", "allow", 0), ("*", "allow", -1), ("doubleclick^", "block", 0), ("||adserver*.", "block", 0),
              ("(a+$)[b]{1}\\", "block", 0), ("a-a-a-", "block", 0), ("||net/", "block", 1)]
    rows = [(i, u) for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS row", "'t' AS token").repartition(3)
    got = {r.page_id: r for r in url_rules.judge(df, url_rules.rules(spark, listed)).collect()}
    assert len(got) == len(rows)
    compiled = sorted({(rank, len(p), p, v) for p, v, rank in listed}, reverse=True)
    compiled = [(plain_rule(p), p, v) for _, _, p, v in compiled]
    for i, u in rows:
        rest = u.partition("://")[2] if u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        want = next(((p, v) for x, p, v in compiled if x.search(lower + rest[len(host):])), (None, "allow"))
        assert (got[i].host, got[i].path, got[i].pattern, got[i].verdict) == (lower, path, *want), u


def test_url_rules_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    none = url_rules.rules(spark, [("||net/", "block", 1)]).where("false")
    assert sorted(str(tuple(r)) for r in url_rules.judge(df, none, default="keep").collect()) == [
        "(1, 'a.net', '/', None, None, 'keep')"] * 2 + ["(None, '', '', None, None, 'keep')"]
    assert url_rules.judge(df.where("false"), url_rules.rules(spark, [("||net/", "block", 1)])).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(i, f"http://h{i}.example.net/en/") for i in range(20)] + [(99, "http://rare.example.net/en/")], "page_id long, url string")
    listed = url_rules.rules(spark, [("||rare.example.net/en/", "block", 0), ("*xample*", "allow", 0)])
    tokens = urls.selectExpr("array_distinct(regexp_extract_all(url, '[a-z0-9]+', 0)) AS tokens")
    assert {r.pattern: r.token for r in url_rules._index(tokens, listed).collect()} == {"||rare.example.net/en/": "rare", "*xample*": ""}
