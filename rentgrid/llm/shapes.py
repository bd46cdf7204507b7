"""Shapes of pages and their alignment by simple tree matching.

The shape of a page is the tree of its block elements.  Neighbours of one tag,
one set of marks and one inner structure are one node, so that a run of
paragraphs or of records does not differ from page to page.  Two shapes are
aligned by simple tree matching: the largest top-down pairing that keeps the
order.  Tags must agree; equal marks (class, id, role) only add to the weight
of a pair, so marks that differ by page are still paired by their position.
"""

from __future__ import annotations

import json

import xxhash

from rentgrid.llm.dom import BLOCK, Node

#: A shape of more nodes is no target; pages of any size are aligned with targets.
LARGEST_TARGET = 300
#: Of an element with more children than twice this, so many at both ends are
#: paired; those between keep their path of labels.
ENDS = 1000
#: A target that agrees this much with an earlier one of its host adds nothing.
ALIKE = 0.75


class Shape:
    """A node of a shape; ``nodes`` are the elements that it stands for."""

    __slots__ = ("tag", "marks", "children", "nodes", "structure", "index", "up")

    def __init__(self, tag: str, marks: str, children: list[Shape], nodes: list[Node]):
        self.tag, self.marks, self.children, self.nodes = tag, marks, children, nodes
        self.structure = xxhash.xxh3_64_intdigest(
            f"{tag} {' '.join(str(c.structure) for c in children)}".encode("utf-8", "surrogatepass"))
        self.index = self.up = 0


def _blocks(node: Node):
    """Block elements directly below, seen through inline and unknown ones."""
    stack = list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            continue
        if child.tag in BLOCK:
            yield child
        else:
            stack += reversed(child.children)


def _join(into: Shape, other: Shape) -> None:
    into.nodes += other.nodes
    for a, b in zip(into.children, other.children, strict=True):
        _join(a, b)


def shape(node: Node) -> Shape:
    """The shape of an element, runs of like neighbours merged."""
    children: list[Shape] = []
    for child in _blocks(node):
        new = shape(child)
        last = children[-1] if children else None
        if last and last.marks == new.marks and last.structure == new.structure:
            _join(last, new)
        else:
            children.append(new)
    return Shape(node.tag, node.marks, children, [node])


def numbered(root: Shape) -> list[Shape]:
    """All nodes in page order; each knows its number and its parent's."""
    out, stack = [], [(root, -1)]
    while stack:
        at, up = stack.pop()
        at.index, at.up = len(out), up
        out.append(at)
        stack += [(c, at.index) for c in reversed(at.children)]
    return out


def dump(root: Shape) -> str:
    """Tags and marks of a shape as JSON."""
    def plain(s):
        return [s.tag, s.marks, [plain(c) for c in s.children]]
    return json.dumps(plain(root), separators=(",", ":"))


def load(text: str) -> Shape:
    def built(x):
        return Shape(x[0], x[1], [built(c) for c in x[2]], [])
    return built(json.loads(text))


def match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the largest weight of a top-down pairing in order,
    and its pairs.  A pair weighs 2, or 1 where the marks differ."""
    tables: dict[tuple[int, int], list[list[int]]] = {}

    def ends(x: Shape) -> list[Shape]:
        return x.children if len(x.children) <= 2 * ENDS else x.children[:ENDS] + x.children[-ENDS:]

    def weigh(x: Shape, y: Shape) -> int:
        if x.tag != y.tag:
            return 0
        xs = ends(x)
        n, m = len(xs), len(y.children)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        tables[id(x), id(y)] = best
        for i in range(n):
            above, row, left = best[i], best[i + 1], xs[i]
            for j in range(m):
                w = weigh(left, y.children[j])
                row[j + 1] = max(above[j + 1], row[j], above[j] + w if w else 0)
        return best[n][m] + (2 if x.marks == y.marks else 1)

    total = weigh(a, b)
    pairs, stack = [], [(a, b)] if total else []
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        best, xs = tables[id(x), id(y)], ends(x)
        i, j = len(xs), len(y.children)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:  # only the pair explains the gain
                i, j = i - 1, j - 1
                stack.append((xs[i], y.children[j]))
    return total, pairs


class Targets:
    """The alignment targets of a host, in the order given; those much like an
    earlier one are left out."""

    def __init__(self, dumped: list[str]):
        self.roots: list[list[Shape]] = []
        for text in dumped:
            nodes = numbered(load(text))
            if all(match(nodes[0], t[0])[0] < ALIKE * 2 * max(len(t), len(nodes)) for t in self.roots):
                self.roots.append(nodes)
        self.known: dict[bytes, tuple[int, list[int]]] = {}

    def align(self, body: Node) -> tuple[int, dict[int, int]]:
        """The best target's number (-1: none), and for each paired element
        (by ``id``) the number of its target node."""
        if not self.roots:
            return -1, {}
        nodes = numbered(shape(body))
        key = xxhash.xxh3_128_digest(dump(nodes[0]).encode("utf-8", "surrogatepass"))
        found = self.known.get(key)
        if found is None:
            most, found = 0, (-1, [])
            for t, target in enumerate(self.roots):
                total, pairs = match(nodes[0], target[0])
                if total > most:
                    numbers = [-1] * len(nodes)
                    for x, y in pairs:
                        numbers[x.index] = y.index
                    most, found = total, (t, numbers)
            if len(self.known) > 1000:
                self.known.clear()
            if len(nodes) <= LARGEST_TARGET:
                self.known[key] = found
        t, numbers = found
        return t, {id(e): number for s, number in zip(nodes, numbers, strict=True) if number >= 0 for e in s.nodes}
