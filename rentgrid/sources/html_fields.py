"""Raw HTML -> field texts with the standard-library HTML parser (A3 input).

Regex cannot read HTML faithfully (entities, nesting, script bodies), so
this step runs Python's ``html.parser`` inside ``mapInPandas``: Spark
partitions the pages and hands them over in Arrow batches; one parser per
page collects the title text (entities decoded), the links and the amount
of visible text (script and style bodies excluded).
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "page_id long, title string, links int, first_link string, text_chars long"


class _Fields(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title_parts: list[str] = []
        self.links: list[str] = []
        self.text_chars = 0
        self._stack: list[str] = []

    def handle_starttag(self, tag, attrs):
        self._stack.append(tag)
        if tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.links.append(href)

    def handle_endtag(self, tag):
        if tag in self._stack:
            while self._stack and self._stack.pop() != tag:
                pass

    def handle_data(self, data):
        inside = self._stack[-1] if self._stack else ""
        if inside == "title":
            self.title_parts.append(data)
        elif inside not in ("script", "style"):
            self.text_chars += len(data.strip())


def _parse(batches):
    for pdf in batches:
        out = []
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            p = _Fields()
            p.feed(html or "")
            p.close()
            out.append((pid, "".join(p.title_parts).strip(), len(p.links), p.links[0] if p.links else None,
                        p.text_chars))
        yield pd.DataFrame(out, columns=["page_id", "title", "links", "first_link", "text_chars"])


def html_fields(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "html").mapInPandas(_parse, SCHEMA)
