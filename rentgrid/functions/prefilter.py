"""Required-literal prefilters for regex rules.

A rule like ``\\b(?:gastown)\\b`` can only match a text that contains
``gastown``.  Testing that with ``contains`` (a byte search, no string
decoding) is several times cheaper than running the regex, and most texts
fail it, so every rule is evaluated as ``contains_any(text, literals) AND
regex(text)``.  Spark's ``AND`` skips the regex when the first test fails,
so results are unchanged; only impossible matches are skipped.

``required_literals`` reads the pattern with Python's own regex parser and
returns a set of strings such that every match contains at least one of
them, or ``None`` when no useful set exists (e.g. the pattern can match
without any fixed text).
"""

from __future__ import annotations

import functools

try:  # Python 3.11+
    from re import _constants as C  # type: ignore[attr-defined]
    from re import _parser as sre_parse  # type: ignore[attr-defined]
except ImportError:  # pragma: no cover
    import sre_constants as C  # type: ignore[no-redef]
    import sre_parse  # type: ignore[no-redef]

MIN_LITERAL = 3          # shorter literals filter too little to pay off
MAX_ALTERNATIVES = 12    # more 'contains' tests than this cost more than they save


def _seq(items) -> list[set[str]] | None:
    """Candidate required sets of a sequence of parse items."""
    cands: list[set[str]] = []
    run: list[str] = []

    def flush():
        if run:
            cands.append({"".join(run)})
            run.clear()

    for op, av in items:
        if op is C.LITERAL:
            run.append(chr(av))
            continue
        flush()
        sub = _node(op, av)
        if sub:
            cands.append(sub)
    flush()
    return cands


def _best(cands: list[set[str]]) -> set[str] | None:
    good = [c for c in cands if c and min(map(len, c)) >= MIN_LITERAL and len(c) <= MAX_ALTERNATIVES]
    if not good:
        return None
    return max(good, key=lambda c: (min(map(len, c)), -len(c)))


def _node(op, av) -> set[str] | None:
    if op is C.SUBPATTERN:
        return _best(_seq(av[-1]))
    if op is C.BRANCH:
        out: set[str] = set()
        for alt in av[1]:
            req = _best(_seq(alt))
            if req is None:
                return None
            out |= req
        return out
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
        lo, _hi, sub = av
        return _best(_seq(sub)) if lo >= 1 else None
    if op is getattr(C, "ATOMIC_GROUP", None):
        return _best(_seq(av))
    return None  # classes, any, anchors, back references: no fixed text


@functools.lru_cache(maxsize=None)
def required_literals(pattern: str, ignore_case: bool = False) -> tuple[str, ...] | None:
    try:
        parsed = sre_parse.parse(pattern)
    except Exception:  # pragma: no cover - patterns are fixed and valid
        return None
    req = _best(_seq(list(parsed)))
    if req is None:
        return None
    if ignore_case:
        req = {s.lower() for s in req}
    return tuple(sorted(req))


# Folding applied to the text a case-insensitive prefilter reads: beyond
# lower-casing, characters that match an ASCII letter only under Unicode case
# folding are mapped to it, so the prefilter never rejects a real match.
FOLD_FROM = "ſı"
FOLD_TO = "si"
DOTTED_I = "i̇"
