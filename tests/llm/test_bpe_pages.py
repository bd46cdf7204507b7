import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from rentgrid.llm import bpe, dom, shapes, wrapper

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, make, odd, clash, prose, library):
    rng = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "1", "²", "'s", "!", "漢", "\r\n", "_", "<|endoftext|>"]
    rows = odd + [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(200, "x" * 3000), (201, "ab" * 2000), (202, prose(400, 3))]
    got = {r.doc_id: r for r in bpe.round_trip(clash(make(rows)), PATH, PATTERN, with_ids=True).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(make([(1, "x")]).limit(0), PATH, PATTERN).count() == 0


def test_encode_then_decode(spark, make, odd):
    out = bpe.decode(bpe.encode(make(odd), PATH, PATTERN), PATH, PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in out.collect()} == {i: (t or "").encode() for i, t in odd}


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = [b"%d" % i for i in range(3000)]
    h = bpe.PerfectHash(keys, list(range(3000)))
    assert len(h.keys) == 3000 and all(h.get(k) == i for i, k in enumerate(keys))
    assert h.get(b"x") is None and bpe.PerfectHash([], []).get(b"x") is None


def page(title, article, extra=""):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><header>Site of {title}</header>"
            f"<nav><ul><li><a href=/x>{title} menu</a></ul></nav><div class='cookie-notice'>We use cookies {title}</div>"
            f"<main class=content>{article}<p>Follow us every day</p>{extra}</main><aside>More {title}</aside>"
            f"<section id=comments><article class=comment>I liked {title}</article></section><footer>&copy; {title}</footer>")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def test_template_goes_and_slots_stay(spark, clash):
    rows = [(i, f"http://h.example/{i}", page(f"T{i}", f"<h1>Title {i}</h1><p>Body &amp; <b>text</b>\n  number {i}<br>end"))
            for i in range(8)]
    got = {r.page_id: r.text for r in wrapper.extract(clash(pages(spark, rows))).collect()}
    assert got == {i: f"Title {i} Body & text number {i} end" for i in range(8)}


def test_copies_of_one_page_are_no_template(spark):
    rows = [(i, "http://h.example/", page("Same", "<p>The one article</p>")) for i in range(9)]
    got = {r.text for r in wrapper.extract(pages(spark, rows)).collect()}
    assert got == {"The one article Follow us every day"}


def test_odd_pages(spark):
    rows = [(1, "http://a.example/", None), (2, None, ""), (3, "x", "no tags at all"), (4, "http://a.example/", "<p>unclosed <b>b"),
            (5, "http://a.example/", "<div><article><p>one<p>two<ul><li>three<li>four</ul>five"), (6, None, "<script>x<y</script>"),
            (7, "http://b.example", "<article>a<form>b</form><!-- c --><div class=ad>d</div>e</article>"),
            (8, "http://b.example", "<p>" + "word " * 50000)]
    got = {r.page_id: (r.text, r.n_chars) for r in wrapper.extract(pages(spark, rows + rows[:1])).collect()}
    assert got[1] == got[2] == got[6] == ("", 0)
    assert got[3][0] == "no tags at all" and got[4][0] == "unclosed b" and got[5][0] == "one two three four five"
    assert got[7][0] == "a e" and got[8][1] == 50000 * 5 - 1
    assert wrapper.extract(pages(spark, rows).limit(0)).count() == 0


def test_wrappers_too_large_to_send_are_joined(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.example/{i}", page(f"T{i}", f"<p>Body {i}")) for i in range(10)] + [(99, None, "<p>x")]
    want = sorted(map(tuple, wrapper.extract(pages(spark, rows)).collect()), key=str)
    monkeypatch.setattr(wrapper, "SENT_BYTES", 0)
    assert sorted(map(tuple, wrapper.extract(pages(spark, rows)).collect()), key=str) == want


def tree(text):
    return shapes.shape(dom.parse(f"<body>{text}</body>").children[0])


def test_simple_tree_matching():
    a, b = tree("<div><p>x</p><ul><li>y</ul></div>"), tree("<div><ul><li>z</ul><p>w</p></div>")
    total, pairs = shapes.match(a, b)
    assert shapes.match(a, a)[0] == 10 and total == 8 and len(pairs) == 4
    # marks that differ are paired by position; runs of one structure are one node
    c = tree("<div class=q><p>1<p>2<p>3</div><div class=r>end</div>")
    d = tree("<div class=u><p>1</div><div class=v>end</div>")
    assert shapes.match(c, d)[0] == 6 and len(shapes.numbered(c)) == 4


def brute_match(a, b):
    """All top-down pairings in order, without a table."""
    def lists(xs, ys):
        if not xs or not ys:
            return 0
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), whole(xs[0], ys[0]) + lists(xs[1:], ys[1:]))

    def whole(x, y):
        return (2 if x.marks == y.marks else 1) + lists(x.children, y.children) if x.tag == y.tag else 0
    return whole(a, b)


def test_matching_equals_all_pairings():
    rng = random.Random(5)

    def some(depth):
        tag = rng.choice(("div", "ul", "section"))
        inner = "".join(some(depth - 1) for _ in range(rng.randint(0, 3))) if depth else "t"
        return f"<{tag} class={rng.choice('ab')}>{inner}</{tag}>"
    for _ in range(60):
        a, b = tree(some(3)), tree(some(3))
        total, pairs = shapes.match(a, b)
        assert total == brute_match(a, b) == sum(2 if x.marks == y.marks else 1 for x, y in pairs)


def plain_page(i, rng, words):
    """Class names that say nothing, some of them new on each page; all parts but menu, notice and footer vary."""
    def text(n):
        return " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    article = [f"Heading {i} {text(3)}"] + [text(40) for _ in range(rng.randint(2, 5))]
    notice = f"<div class=n{i}>All prices include tax.</div>" if i % 3 else ""
    remarks = "".join(f"<div class=k><div>{text(1)}</div><div>{text(8)}</div></div>" for _ in range(rng.randint(1, 3)))
    page = (f"<html><head><title>{i}</title></head><body><div class=a{i}><ul><li>Home<li>Places<li>About us</ul></div>{notice}"
            f"<div class=x{i % 5}><h1>{article[0]}</h1>" + "".join(f"<p>{p}</p>" for p in article[1:]) +
            f"</div><div class=z{i}>{remarks}</div><div class=q{i}>Copyright of the owners</div></body></html>")
    return page, " ".join(article)


def test_slots_alone_tell_the_article(spark):
    rng, words = random.Random(9), "amber birch cedar delta ember frost grove heron inlet jetty".split()
    made = [plain_page(i, rng, words) for i in range(40)]
    rows = [(i, f"http://plain.example/{i}", html) for i, (html, _) in enumerate(made)]
    for hints in (True, False):
        got = {r.page_id: r.text for r in wrapper.extract(pages(spark, rows), hints=hints).collect()}
        assert got == {i: text for i, (_, text) in enumerate(made)}


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    wide = "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(3000))
    rows = [(i, "http://d.example/", html) for i, html in enumerate((deep, wide, "<b>" * 3000 + "bold", "</div>" * 3000))]
    got = {r.page_id: r.text for r in wrapper.extract(pages(spark, rows)).collect()}
    assert got == {0: "deep text", 1: " ".join(f"h{i} p{i}" for i in range(3000)), 2: "bold", 3: ""}


def test_templates_come_from_all_pages_of_a_host(spark):
    words = "amber birch cedar delta ember frost grove heron inlet jetty".split()

    def article(i):
        return " ".join(words[(i * k + k) % 10] + str(i) for k in range(12))

    def html(i, inside):
        return f"<html><head><title>t{i}</title></head><body><article>{inside}</article></body></html>"

    line, shared = "Printed with permission of the owners.", "This passage stands in a few articles only."
    # three layouts, each with a constant block of its own
    rows = [(i, f"https://large.example/{i}", html(i, f"<p>{article(i)}</p>" + (
        f"<div class='end{i % 3}'>{line}</div>"))) for i in range(60)]
    rows += [(100 + i, f"https://copies.example/{i}", html(100 + i, f"<p>{shared if i < 4 else article(i)}</p><p>{article(i + 7)}</p>"))
             for i in range(12)]
    got = {r.page_id: r.text for r in wrapper.extract(pages(spark, rows)).collect()}
    assert not any(line in got[i] for i in range(60))
    assert all(got[i].startswith(article(i)) for i in range(60))
    assert all(shared in got[100 + i] for i in range(4))
