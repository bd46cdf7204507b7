"""A tolerant reader of HTML into a small tree."""

from __future__ import annotations

import html as _html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object"))
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead tr ul""".split())
#: What an opening tag closes, if it is open within the given limits.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
           "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
           "option": ("option", ("select",))}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


#: Elements nested deeper than this stand beside each other in the one at that
#: depth, as browsers do; walks of a tree may then recurse.
DEEPEST = 300


class Node:
    """An element: tag, words of its class, id and role, and what is in it."""

    __slots__ = ("tag", "marks", "children", "parent")

    def __init__(self, tag: str, marks: str, parent: Node | None):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.children: list[Node | str] = []


def parse(text: str) -> Node:
    """The tree under a root node.  Missing and stray tags never fail."""
    root = now = Node("#root", "", None)
    at = depth = beyond = 0
    find = _TOKEN.search
    while m := find(text, at):
        if m.start() > at:
            now.children.append(text[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if beyond:
                beyond -= 1
                continue
            up, ups = now, 1
            while up is not root and up.tag != tag:
                up, ups = up.parent, ups + 1
            if up is not root:
                now, depth = up.parent, depth - ups
            continue
        if tag in _CLOSES or (tag in BLOCK and now.tag != "#root"):
            closed = _close(now, root, tag)
            while now is not closed:
                now, depth, beyond = now.parent, depth - 1, 0
        marks = ""
        if m[3] and ("=" in m[3] or "hidden" in m[3]):
            marks = " ".join((a[1] or a[2] or a[3] or a[0]) for a in _ATTRIBUTE.findall(m[3])).lower()
        node = Node(tag, marks, now)
        now.children.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            stop = end.start() if end else len(text)
            if stop > at:
                node.children.append(text[at:stop])
            at = end.end() if end else len(text)
            continue
        if depth == DEEPEST:
            beyond += 1
            continue
        now, depth = node, depth + 1
    if at < len(text):
        now.children.append(text[at:])
    return root


def _close(now: Node, root: Node, tag: str) -> Node:
    """Where an opening tag goes: behind an open p, or its own kind."""
    closed, limits = _CLOSES.get(tag, ("p", ()))
    kinds = closed.split()
    if tag in BLOCK and "p" not in kinds:
        kinds.append("p")
    up = now
    while up is not root:
        if up.tag in kinds:
            return up.parent
        if up.tag in limits or (up.tag in BLOCK and up.tag not in kinds):
            return now
        up = up.parent
    return now


def clean(parts: list[str]) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    joined = "".join(parts)
    return " ".join((_html.unescape(joined) if "&" in joined else joined).split())
