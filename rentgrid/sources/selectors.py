"""Records read from HTML by declared selectors, in Arrow batches.

A ``Record`` says what one record is on a page (elements that match one of its
``each`` lists, the first list that matches any; without lists the page) and
which ``Field``s it has.  A field is the first element of the record, in page
order, that matches its selector: its text, or its first non-empty attribute
of those named; with ``many`` it is that of all such elements.

Selectors are comma lists of descendant chains of ``tag``, ``.class``, ``#id``,
``[attr]``, ``[attr="value"]`` and ``[attr*="part"]``.  Texts are as shown:
line breaks and block elements break the line, scripts and styles are left
out, character references are decoded.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript", "head"))
_BLOCK = frozenset("""address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li
main nav ol p pre section table tbody td th thead tr ul""".split())
#: Elements that an opening tag of the same kind ends.
_SIBLINGS = frozenset(("li", "p", "option", "tr", "td", "th", "dt", "dd"))
#: A task holds the records of so many characters of HTML at a time, or of one page.
CHUNK_CHARS = 1 << 20
_PART = re.compile(r"""(?P<tag>^[a-z][a-z0-9]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
                       |\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)["']?(?P<value>[^"'\]]*)["']?)?\]""", re.X)


class Field(NamedTuple):
    selector: str  # "" is the record's own element
    take: tuple = ()  # attributes; none: the text
    many: bool = False


class Record(NamedTuple):
    each: tuple  # selectors, tried in turn
    fields: dict


class _Element:
    __slots__ = ("tag", "attrs", "classes", "above", "first", "last", "start", "end")

    def __init__(self, tag, attrs, above, number, start):
        self.tag, self.attrs, self.above = tag, {k: v or "" for k, v in attrs}, above
        self.classes = self.attrs["class"].split() if "class" in self.attrs else ()
        self.first = self.last = number  # numbers of the element and the last one inside
        self.start = self.end = start  # its run of texts


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements, self.texts, self.now, self.hidden = [], [], None, 0

    def handle_starttag(self, tag, attrs):
        open_tag = self.now.tag if self.now is not None else ""
        if (tag in _SIBLINGS and open_tag == tag) or (open_tag == "p" and tag in _BLOCK and tag != "br"):
            self._close(self.now)
        if tag in _BLOCK:
            self.texts.append("\n")
        e = _Element(tag, attrs, self.now, len(self.elements), len(self.texts))
        self.elements.append(e)
        if tag in _VOID:
            return
        self.now = e
        self.hidden += tag in _HIDDEN

    def handle_endtag(self, tag):
        e = self.now
        while e is not None and e.tag != tag:
            e = e.above
        if e is not None:
            self._close(e)

    def _close(self, upto):
        """Ends an element and all that is open inside it."""
        while True:
            e, self.now = self.now, self.now.above
            e.last, e.end = len(self.elements) - 1, len(self.texts)
            self.hidden -= e.tag in _HIDDEN
            if e.tag in _BLOCK:
                self.texts.append("\n")
            if e is upto:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.texts.append(data)

    def close(self):
        super().close()
        while self.now is not None:
            self._close(self.now)


def _tests(compound: str) -> list:
    out, at = [], 0
    while at < len(compound):
        m = _PART.match(compound, at)
        if not m:
            raise ValueError(f"not a selector: {compound}")
        at, g = m.end(), m.groupdict()
        if g["tag"]:
            out.append(lambda e, v=g["tag"]: e.tag == v)
        elif g["cls"]:
            out.append(lambda e, v=g["cls"]: v in e.classes)
        elif g["id"]:
            out.append(lambda e, v=g["id"]: e.attrs.get("id") == v)
        elif g["op"] == "*=":
            out.append(lambda e, k=g["attr"], v=g["value"]: v in e.attrs.get(k, ""))
        elif g["op"]:
            out.append(lambda e, k=g["attr"], v=g["value"]: e.attrs.get(k) == v)
        else:
            out.append(lambda e, k=g["attr"]: k in e.attrs)
    return out


def _all(tests: list):
    """One test for all tests of a compound; most have one, which is called for
    every element of every page."""
    if len(tests) == 1:
        return tests[0]
    return lambda e: all(t(e) for t in tests)


def _chain(compounds: list):
    *outer, last = compounds
    if not outer:
        return last

    def matched(e):
        if not last(e):
            return False
        rest, up = len(outer), e.above
        while rest and up is not None:
            if outer[rest - 1](up):
                rest -= 1
            up = up.above
        return not rest
    return matched


def matcher(selector: str):
    """Whether an element matches a selector list."""
    # commas and spaces inside brackets are part of a value
    lists = re.findall(r"(?:\[[^\]]*\]|[^,\[])+", selector)
    chains = [_chain([_all(_tests(c)) for c in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", chain)]) for chain in lists]

    def matched(e):
        for chain in chains:
            if chain(e):
                return True
        return False
    return chains[0] if len(chains) == 1 else matched


def _records(html: str, each, fields):
    """The field values of every record of a page, in page order."""
    page = _Page()
    page.feed(html)
    page.close()
    whole = _Element("", (), None, -1, 0)
    whole.last, whole.end = len(page.elements) - 1, len(page.texts)
    found = [whole]
    for match in each:
        found = [e for e in page.elements if match(e)]
        if found:
            break

    def value(e, take):
        if not take:
            return "".join(page.texts[e.start:e.end]).strip()
        return next((e.attrs[a] for a in take if e.attrs.get(a)), "")
    for record in found:
        inside, out = page.elements[record.first + 1:record.last + 1], {}
        for name, (match, take, many) in fields.items():
            if many:
                out[name] = [value(e, take) for e in inside if match(e)]
            else:
                e = record if match is None else next((e for e in inside if match(e)), None)
                out[name] = None if e is None else value(e, take)
        yield out


def record_batches(batches, record: Record, key: str):
    """The records of every page of Arrow batches ``key, html``; a batch of
    pages is large, so that its records are given in parts."""
    names = list(record.fields)
    each = [matcher(s) for s in record.each]
    fields = {n: (matcher(f.selector) if f.selector else None, f.take, f.many) for n, f in record.fields.items()}
    for batch in batches:
        keys, pages, row = batch.column(0), batch.column(1), 0
        while row < batch.num_rows:
            rows, pos, columns, chars = [], [], {n: [] for n in names}, 0
            while row < batch.num_rows and chars < CHUNK_CHARS:
                text = pages[row].as_py() or ""
                for i, r in enumerate(_records(text, each, fields)):
                    rows.append(row)
                    pos.append(i)
                    for n in names:
                        columns[n].append(r[n])
                chars += len(text)
                row += 1
            typed = [pa.array(columns[n], pa.list_(pa.string()) if record.fields[n].many else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), *typed], [key, "pos", *names])


def read_records(pages: DataFrame, record: Record, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos`` and the fields of every record of every page: strings, NULL
    without such an element; arrays for ``many``.  NULL pages are empty."""
    kind = pages.schema[key].dataType
    schema = ", ".join([f"`{key}` {kind.simpleString()}", "pos int"] + [
        f"{n} {'array<string>' if f.many else 'string'}" for n, f in record.fields.items()])

    def read(batches):
        yield from record_batches(batches, record, key)
    return pages.select(F.col(key), F.col(html)).mapInArrow(read, schema)
