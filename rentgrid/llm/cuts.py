"""Groups of two tokenisations of the same bytes, by divide and conquer at
shared cuts, for many texts at once."""

from __future__ import annotations

import numpy as np

#: Ends near the middle that are tried one by one before all of an interval.
PROBES = 6


def _common(ends: np.ndarray, other: np.ndarray, at: np.ndarray):
    """Where the ends at ``at`` stand among the other's (by bisection), and
    whether they are ends there too."""
    found = np.searchsorted(other, ends[at])
    return found, other[np.minimum(found, len(other) - 1)] == ends[at]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray):
    """Token numbers (of a, of b) behind which both tokenisations are cut,
    ascending.

    ``ends`` are the byte ends of all tokens, rising over all texts; ``stops``
    are the token counts up to the end of each text, which is a shared cut.
    Each interval looks for a common end near its middle: an end of a is
    bisected among those of b, then the ends beside it.  At the end found the
    interval falls into two halves; one without is a leaf.  All intervals of a
    depth are worked on together.
    """
    low_a, low_b = np.append(0, stops_a[:-1]), np.append(0, stops_b[:-1])
    high_a, high_b = np.asarray(stops_a), np.asarray(stops_b)
    cuts_a, cuts_b = [high_a], [high_b]
    while len(low_a):
        # an interval of one token has no end inside
        inner = (high_a - low_a > 1) & (high_b - low_b > 1)
        low_a, high_a, low_b, high_b = low_a[inner], high_a[inner], low_b[inner], high_b[inner]
        middle = (low_a + high_a) // 2 - 1
        cut_a, cut_b = np.full(len(low_a), -1), np.full(len(low_a), -1)
        waiting = np.arange(len(low_a))
        for probe in range(PROBES):
            if not len(waiting):
                break
            at = middle[waiting] + ((probe + 1) // 2 if probe % 2 else -(probe // 2))
            inside = (at >= low_a[waiting]) & (at < high_a[waiting] - 1)
            at = np.where(inside, at, middle[waiting])
            found, same = _common(ends_a, ends_b, at)
            hit = waiting[same]
            cut_a[hit], cut_b[hit] = at[same] + 1, found[same] + 1
            waiting = waiting[~same]
        waiting = waiting[high_a[waiting] - low_a[waiting] - 1 > PROBES // 2]
        if len(waiting):
            _nearest(ends_a, ends_b, low_a, high_a, middle, waiting, cut_a, cut_b)
        split = cut_a >= 0
        cut_a, cut_b = cut_a[split], cut_b[split]
        cuts_a.append(cut_a)
        cuts_b.append(cut_b)
        low_a, high_a = np.concatenate((low_a[split], cut_a)), np.concatenate((cut_a, high_a[split]))
        low_b, high_b = np.concatenate((low_b[split], cut_b)), np.concatenate((cut_b, high_b[split]))
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _nearest(ends_a, ends_b, low, high, middle, waiting, cut_a, cut_b):
    """For intervals without a common end close to the middle: all their ends,
    bisected at once, and of the common ones the nearest to the middle."""
    many = high[waiting] - low[waiting] - 1
    owner = np.repeat(np.arange(len(waiting)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[waiting][owner]
    found, same = _common(ends_a, ends_b, at)
    owner, at, found = owner[same], at[same], found[same]
    order = np.lexsort((at, np.abs(at - middle[waiting][owner]), owner))
    first = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
    hit = waiting[owner[first]]
    cut_a[hit], cut_b[hit] = at[first] + 1, found[first] + 1
