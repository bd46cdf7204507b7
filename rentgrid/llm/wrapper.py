"""Main text of web pages by wrapper induction (operator 3).

1. Every page of a host is read into the shape of its block elements; the most
   frequent shapes of a host are the targets of alignment (their number does
   not bound what is read: every page is aligned with its best target).
2. Every page is aligned with its target by simple tree matching
   (``shapes.match``).  An element's slot is the target node that it is paired
   with; elements without one are told by the labels below the nearest slot.
   For each slot, titles and shared texts are counted over all pages.
3. Texts that most titles share in a slot are the host's template.  Of the
   texts that vary, slot by slot, the target's content is the part of the tree
   that holds most of them.
4. Of every page, template texts go and the others of the content slots stay.

Tags and class names are a weak prior (``hints=False`` leaves them out): what they
mark as a menu, advert, form or comment is left out also inside the content.  They
name the article where the slots cannot: on hosts with too few titles, and on
pages that match no target of their host, seen by content slots that hold nothing
or less than half of what the page's own article element does.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm import dom, shapes
from rentgrid.llm.tables import small_batches, written

#: A text is template if at least so many titles of the host have it in a slot,
#: and more than this share of the titles that have the slot.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.5
#: Alignment targets of a host.
TARGETS = 4
#: The content of a target is followed down into a child that holds at least
#: this share of the varying text.
CONTENT_SHARE = 0.5
#: A large host is joined with its wrapper in so many parts.
SALTS = 32
#: Wrappers of all hosts together are sent to the executors up to this size;
#: beyond it they are joined by host.
SENT_BYTES = 32 << 20

#: Elements that never hold article text.
_NEVER = frozenset("""script style noscript template iframe textarea title head svg math object nav footer aside form
button select option input dialog menu canvas audio video embed label fieldset""".split())
#: Elements whose text no reader sees, or that are no text.
_UNSEEN = frozenset("""script style noscript template iframe textarea title head svg math object form button select
option input dialog canvas audio video embed""".split())
_BOILERPLATE = re.compile(r"""(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner\w*|nav\w*|
menu\w*|side(?:bar|nav)?\w*|aside|foot(?:er)?\w*|masthead|topbar|toolbar|breadcrumb\w*|crumb\w*|cookie\w*|consent|
gdpr|notice\w*|notification\w*|alert\w*|disclaimer|popup|modal|overlay|newsletter\w*|subscri\w*|signup|login|share\w*|
sharing|social\w*|related\w*|recommend\w*|teaser\w*|widget\w*|pag(?:er|ination)|comment\w*|repl(?:y|ies)|discussion|
respon(?:d|ses?)|disqus|reader-?\w*|tags?|search\w*|form\w*|hidden|skip\w*|copyright|contentinfo|navigation|
complementary)(?=$|[\s_-])""", re.X)
_HEADER = re.compile(r"(?:^|[\s_-])(?:site|page|top|global|main)?-?header(?=$|[\s_-])|(?:^|\s)head(?=$|\s)")
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|text|body)(?=$|[\s_-])")


def _is_boilerplate(node: dom.Node, inside: bool) -> bool:
    """Whether an element holds none of the article; ``inside``: it stands in
    the article, whose own header is part of it."""
    if node.tag in _NEVER:
        return True
    if node.tag == "header" and not inside:
        return True
    if node.marks and node.tag not in ("html", "body", "article", "main"):
        return bool(_BOILERPLATE.search(node.marks)) or (not inside and bool(_HEADER.search(node.marks)))
    return bool(node.marks) and node.tag == "article" and "comment" in node.marks


class _Blocks:
    """Text blocks of a page in order: text, element, length of its links, and
    whether it stands in the element named as the article."""

    def __init__(self, body: dom.Node, root: dom.Node | None, hints=True):
        self.out: list[tuple[str, dom.Node, int, bool]] = []
        self.parts: list[str] = []
        self.links = 0
        self.hints, self.root = hints, root
        self.inside = self.named = body is root
        self._walk(body, body, False)
        self._flush(body)

    def _flush(self, owner: dom.Node) -> None:
        if self.parts:
            text = dom.clean(self.parts)
            if text:
                self.out.append((text, owner, self.links, self.named))
            self.parts, self.links = [], 0

    def _walk(self, node: dom.Node, block: dom.Node, linked: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.parts.append(child)
                if linked:
                    self.links += len(child)
            elif child.tag == "br":
                self.parts.append(" ")
            elif child.tag in dom.VOID or (_is_boilerplate(child, self.inside) if self.hints else child.tag in _UNSEEN):
                if child.tag in dom.BLOCK or child.tag in _NEVER:
                    self._flush(block)
            elif child.tag in dom.BLOCK:
                self._flush(block)
                before = self.inside, self.named
                self.named = self.named or child is self.root
                self.inside = self.inside or self.named or child.tag in ("article", "main")
                self._walk(child, child, linked)
                self._flush(child)
                self.inside, self.named = before
            else:
                self._walk(child, block, linked or child.tag == "a")


def _body(root: dom.Node) -> dom.Node:
    stack, found = [root], None
    while stack:
        node = stack.pop()
        if node.tag == "body":
            found = node
            break
        stack += [c for c in reversed(node.children) if isinstance(c, dom.Node)]
    return found or root


#: Elements that hold blocks; a paragraph's or list's container is the nearest of them.
_HOLDERS = frozenset("body div section article main td blockquote center nav aside header footer figure #root".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Nodes of targets are told apart across the targets of a host by this factor.
_PER_TARGET = 10_000


def _hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


class Page:
    """A page in its host's terms: ``blocks`` are (slot, place, text, links, named as
    article, owner is a heading); the place is the target node of the container."""

    def __init__(self, html: str, targets: shapes.Targets, hints: bool = True):
        body = _body(dom.parse(html))
        self.root = _article(body) if hints else None
        self.target, paired = targets.align(body)
        base = self.target * _PER_TARGET
        slots, places, stack = {}, {}, [(body, 0, base if self.target >= 0 else -1)]
        while stack:
            node, path, place = stack.pop()
            number = paired.get(id(node))
            if number is not None:
                path = xxhash.xxh3_64_intdigest(b"paired", base + number)
                if node.tag in _HOLDERS:
                    place = base + number
            slots[id(node)], places[id(node)] = path, place
            for c in node.children:
                if isinstance(c, dom.Node):
                    stack.append((c, xxhash.xxh3_64_intdigest(
                        f"{c.tag} {c.marks}".encode("utf-8", "surrogatepass"), path), place))
        self.blocks = [(slots[id(owner)] - (slots[id(owner)] >> 63 << 64), places[id(owner)], text, links, named,
                        owner.tag in _HEADINGS)
                       for text, owner, links, named in _Blocks(body, self.root, hints).out]


class Wrapper:
    """A host's wrapper as read from its JSON; without one every page stands alone."""

    def __init__(self, text: str | None):
        found = json.loads(text) if text else {}
        self.targets = shapes.Targets(found.get("targets", []))
        self.content = frozenset(found.get("content", ()))
        self.template = frozenset((int(a), bytes.fromhex(b)) for a, _, b in
                                  (x.partition(":") for x in found.get("template", ())))

    def text(self, html: str, hints: bool = True) -> str:
        page = Page(html, self.targets, hints)
        placed, other = [], []
        for slot, place, text, links, named, _ in page.blocks:
            if (slot, _hash(text)) in self.template:
                continue
            if place in self.content:
                placed.append(text)
            if named or (page.root is None and links * 2 <= len(text)):
                other.append(text)
        if not placed or (page.root is not None and sum(map(len, placed)) * 2 < sum(map(len, other))):
            return " ".join(other)
        return " ".join(placed)


class _Wrappers:
    """Wrappers of the hosts that a worker meets, a bounded number at once."""

    def __init__(self):
        self.known: dict[str | None, Wrapper] = {}

    def get(self, text: str | None) -> Wrapper:
        if text not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            self.known[text] = Wrapper(text)
        return self.known[text]


def content_places(targets: list[str], places: dict[int, tuple[int, int]], titles: dict[int, int]) -> list[int]:
    """The places of the article, for each target: from the body down into the
    child that holds most of the varying text, as long as what stands beside it
    in the node itself is headings or nothing.

    ``places``: for each place the varying text under headings and other;
    ``titles``: how many titles have it.  Targets of too few titles have none.
    """
    out = []
    for t, nodes in enumerate(shapes.Targets(targets).roots):
        own = [places.get(t * _PER_TARGET + s.index, (0, 0)) for s in nodes]
        total = [sum(x) for x in own]
        for s in reversed(nodes[1:]):
            total[s.up] += total[s.index]
        if not total[0] or max(titles.get(t * _PER_TARGET + s.index, 0) for s in nodes) < LEAST_PAGES:
            continue
        at = nodes[0]
        while True:
            best = max(at.children, key=lambda c: total[c.index], default=None)
            if best is None or own[at.index][1] or total[best.index] < CONTENT_SHARE * total[at.index]:
                break
            if own[at.index][0]:
                out.append(t * _PER_TARGET + at.index)
            at = best
        stack = [at]
        while stack:
            node = stack.pop()
            out.append(t * _PER_TARGET + node.index)
            stack += node.children
    return sorted(out)


def _length(node: dom.Node) -> int:
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                total += len(c)
            elif not _is_boilerplate(c, True):
                stack.append(c)
    return total


def _article(body: dom.Node) -> dom.Node | None:
    """The element of the article: the longest article or main element, or else
    the longest one that is named like one."""
    named: dict[str, list[dom.Node]] = {"article": [], "main": [], "marks": []}
    stack = [body]
    while stack:
        node = stack.pop()
        for c in node.children:
            if isinstance(c, str) or _is_boilerplate(c, False):
                continue
            if c.tag in ("article", "main"):
                named[c.tag].append(c)
            elif c.marks and c.tag in ("div", "section", "td") and _ARTICLE.search(c.marks):
                named["marks"].append(c)
            stack.append(c)
    for kind in ("article", "main", "marks"):
        if named[kind]:
            best = max(named[kind], key=_length)
            if _length(best):
                return best
    return None


def _shapes(batches):
    """``host, structure, shape`` of every page that can be a target."""
    for b in batches:
        hosts, structures, dumps = [], [], []
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            root = shapes.shape(_body(dom.parse(html)))
            if len(shapes.numbered(root)) <= shapes.LARGEST_TARGET:
                hosts.append(host)
                structures.append(root.structure - (root.structure >> 63 << 64))
                dumps.append(shapes.dump(root))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(structures, pa.int64()),
                                          pa.array(dumps, pa.string())], ["host", "structure", "shape"])


def targets(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: the most frequent shapes of each host, marks apart, over
    all of its pages."""
    counts = pages.select("host", "html").mapInArrow(_shapes, "host string, structure long, shape string").groupBy(
        "host", "structure").agg(F.count(F.lit(1)).alias("pages"), F.min("shape").alias("shape"))
    order = Window.partitionBy("host").orderBy(F.desc("pages"), "structure")
    best = counts.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= TARGETS)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "shape"))), lambda x: x["shape"])
    return best.groupBy("host").agg(F.to_json(F.struct(listed.alias("targets"))).alias("wrapper"))


def _sent(rows: DataFrame, found: DataFrame):
    """Rows with their host's wrapper at the end: sent to every executor where all
    wrappers together are small (a counted size), else joined, a large host in parts."""
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= SENT_BYTES:
        return rows, rows.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in found.collect()})
    parts = found.select("host", "wrapper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = rows.withColumn("part", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    return salted.join(parts, ["host", "part"], "left").select(*rows.columns, "wrapper"), None


def _known(sent, b):
    """The wrapper of each row of a batch; the host is its first column."""
    return [sent.value.get(h) for h in b.column(0).to_pylist()] if sent else b.column(b.num_columns - 1).to_pylist()


_SEEN = "host string, title long, slot long, text binary, place int, heading boolean, size int"


def _seen(sent, hints):
    """``host, title, slot, text, ...`` of every page, once; an empty text stands for the slot."""
    def run(batches):
        known = _Wrappers()
        for b in batches:
            rows, out = [], []
            for i, (html, w) in enumerate(zip(b.column(2).to_pylist(), _known(sent, b), strict=True)):
                found = {(slot, _hash(text), place, heading, len(text))
                         for slot, place, text, _, _, heading in Page(html, known.get(w).targets, hints).blocks}
                found |= {(slot, b"", place, heading, 0) for slot, _, place, heading, _ in found}
                rows += [i] * len(found)
                out += found
            take = pa.array(rows, pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take)] + [
                    pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["host", "title", "slot", "text", "place", "heading", "size"])
    return run


def wrappers(pages: DataFrame, hints: bool = True) -> DataFrame:
    """``host, wrapper``: targets, template (slots and texts) and content places of
    each host, from all of its pages; those of one title count once, so that
    copies of one page do not look like a template."""
    found = written(targets(pages), "wrapper-targets")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    titled = pages.select("host", F.xxhash64(F.when(title == "", F.sha2("html", 256)).otherwise(title)).alias("title"),
                          "html")
    rows, sent = _sent(titled, found)
    # equal rows combine before the shuffle, and are dealt out by title: a large host is in no single task
    counts = written(rows.mapInArrow(_seen(sent, hints), _SEEN).distinct().groupBy(
        "host", "slot", "text", "place", "heading", "size").agg(F.count(F.lit(1)).alias("titles")), "wrapper-texts")
    slots = counts.where("text = X''").groupBy("host", "slot").agg(F.sum("titles").alias("all"))
    shared = counts.where((F.col("text") != F.lit(b"")) & (F.col("titles") >= LEAST_PAGES))
    template = written(shared.join(slots, ["host", "slot"]).where(F.col("titles") > F.col("all") * TEMPLATE_SHARE)
                       .select("host", "slot", "text", "place", "heading", "size", "titles"), "wrapper-template")
    # what is left of each place's text without the template; places are nodes of the few targets
    letters = F.col("size") * F.col("titles")
    titles = F.when(F.col("text") == F.lit(b""), F.col("titles"))
    varying = counts.where("place >= 0").select("host", "place", "heading", letters.alias("n"), titles.alias("t")).unionAll(
        template.where("place >= 0").select("host", "place", "heading", -letters, F.lit(None))).groupBy(
        "host", "place", "heading").agg(F.sum("n").alias("n"), F.max("t").alias("t"))
    placed = varying.groupBy("host").agg(F.collect_list(F.struct("place", "heading", "n", "t")).alias("places"))
    texts = template.groupBy("host").agg(F.sort_array(F.collect_set(
        F.concat_ws(":", "slot", F.lower(F.hex("text"))))).alias("texts"))
    return found.join(placed, "host", "left").join(texts, "host", "left").mapInArrow(
        _wrapped, "host string, wrapper string")


def _wrapped(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            listed = json.loads(r["wrapper"])["targets"]
            places: dict[int, tuple[int, int]] = {}
            titles: dict[int, int] = {}
            for x in r["places"] or ():
                titles[x["place"]] = max(titles.get(x["place"], 0), x["t"] or 0)
                h, o = places.get(x["place"], (0, 0))
                places[x["place"]] = (h + x["n"], o) if x["heading"] else (h, o + x["n"])
            out.append(json.dumps({"targets": listed, "content": content_places(listed, places, titles),
                                   "template": r["texts"] or []}))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["host", "wrapper"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            hints: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null html counts as empty and gives an empty text, as does a page without
    an article; pages without a host are read without a wrapper; repeated rows
    give repeated rows; an empty table gives none; other columns are never
    read.  A very long page costs memory for its own tree; elements nested
    deeper than ``dom.DEEPEST`` stand beside each other.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"),
                        F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)).alias("host"))
    found = written(wrappers(rows.where("host <> '' AND html <> ''"), hints), "wrappers")
    kind = pages.schema[key].dataType.simpleString()
    known, sent = _sent(rows.select("host", "page_id", "url", "html"), found)
    return known.mapInArrow(_reader(sent, hints), f"page_id {kind}, url string, text string, n_chars long")


def _reader(sent, hints):
    def run(batches):
        known = _Wrappers()
        for b in batches:
            texts = [known.get(w).text(html, hints)
                     for html, w in zip(b.column(3).to_pylist(), _known(sent, b), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])
    return run
