"""The required-literal prefilter never rejects a real match: wherever a
rule's pattern matches, one of its literals occurs in the text."""

import re

import pyarrow.parquet as pq
import pytest

from conftest import SF_SMALL
from rentgrid.functions import patterns as P
from rentgrid.functions.prefilter import required_literals
from rentgrid.sources import fixture
from test_extract_goldens import CASES, NEIGHBOURHOODS


def _corpus():
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["text"]).column("text").to_pylist()
    phrases = (fixture.TITLES + fixture.LOCATIONS + fixture.POLICY + fixture.PROPERTY + fixture.TRANSIT
               + fixture.UTILITIES + fixture.LEASE + fixture.NUMBERS)
    golden = [t for _, t, _ in CASES] + [t for t, _ in NEIGHBOURHOODS]
    return [t for t in docs + phrases + golden + [" ".join(phrases)] if t]


def _rules():
    out = [(p, False) for rules in P.CHAIN_RULES.values() for p, _ in rules]
    out += [(p, True) for p, _ in P.NEIGHBOURHOOD_RULES]
    out += [(p, False) for p in P.AGE_RANGE_PATTERNS + P.TRANSIT_DESCRIPTION_PATTERNS]
    out += [(p, False) for p, _ in P.MIN_LEASE_PATTERNS]
    out += [(P.AVAILABLE_MONTH_DATE_PATTERN, False), (P.AVAILABLE_ISO_DATE_PATTERN, False),
            (P.AVAILABLE_NOW_PATTERN, False)]
    return out


@pytest.mark.parametrize("pattern,ci", _rules())
def test_literals_are_necessary(pattern, ci):
    lits = required_literals(pattern, ci)
    if lits is None:
        return
    rx = re.compile(pattern, re.I if ci else 0)
    for text in _corpus():
        t = text if ci else text.lower()
        guard = text.lower() if ci else t
        if rx.search(t):
            assert any(lit in guard for lit in lits), (pattern, lits, text[:80])


def test_literal_examples():
    assert required_literals(r"\bdishwasher\b") == ("dishwasher",)
    assert required_literals(r"\b(?:gym|fitness\s+(?:centre|center|room))\b") == ("fitness", "gym")
    assert required_literals(r"(\d+)\s*ft") is None          # nothing long enough to test for
    assert required_literals(r"\b(?:Gastown)\b", True) == ("gastown",)
