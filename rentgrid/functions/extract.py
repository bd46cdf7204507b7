"""Derived listing columns (the 37 text-to-field extractors) as expressions.

``parsed_fields(d, text, raw_text, loc_text)`` returns ``{column: expr}`` for
one dialect ``d`` (Spark ``Column`` or DuckDB SQL).  Semantics kept:

* chains: the first pattern that matches gives the value, else NULL;
* guarded extractors (age, lease months, prices, rooms): a match whose
  number fails its range check falls through to the next pattern, and only
  the first match of each pattern is considered;
* a number that cannot be read (no digits, too long) gives NULL for the row
  instead of failing the batch.
"""

from __future__ import annotations

import re

from rentgrid.functions import patterns as P
from rentgrid.functions.prefilter import required_literals

# Output columns in canonical listing order, with their SQL types.
PARSED_COLUMNS: list[tuple[str, str]] = [
    ("utilities_included", "boolean"),
    ("pets_allowed", "boolean"),
    ("parking_included", "boolean"),
    ("num_bedrooms", "int"),
    ("num_bathrooms", "int"),
    ("gender_preference", "string"),
    ("couples_allowed", "boolean"),
    ("smoking_allowed", "boolean"),
    ("age_range_min", "int"),
    ("age_range_max", "int"),
    ("vibe", "string"),
    ("lease_type", "string"),
    ("min_lease_months", "int"),
    ("available_from", "string"),
    ("price_min", "int"),
    ("price_max", "int"),
    ("building_type", "string"),
    ("domicile_type", "string"),
    ("room_type", "string"),
    ("shared_living", "boolean"),
    ("furniture_level", "string"),
    ("furnished_bedroom", "boolean"),
    ("furnished_common", "boolean"),
    ("bathroom_type", "string"),
    ("laundry_type", "string"),
    ("transit_proximity", "string"),
    ("transit_description", "string"),
    ("dishwasher", "boolean"),
    ("balcony", "boolean"),
    ("fireplace", "boolean"),
    ("air_conditioning", "boolean"),
    ("ev_charging", "boolean"),
    ("gym_access", "boolean"),
    ("storage_locker", "boolean"),
    ("close_to_amenities", "boolean"),
    ("has_views", "boolean"),
    ("neighbourhood", "string"),
]
PARSED_TYPES = dict(PARSED_COLUMNS)


def gate(d, guard_text, pattern, ignore_case=False):
    """``contains_any`` test that every match of ``pattern`` passes, or None."""
    if guard_text is None:
        return None
    lits = required_literals(pattern, ignore_case)
    return d.contains_any(guard_text, lits) if lits else None


def matches(d, text, pattern, ignore_case=False, guard_text=None):
    """``rlike``, behind a required-literal test where one exists (the
    regex only runs on texts that could match)."""
    cond = d.rlike(text, pattern, ignore_case)
    g = gate(d, guard_text, pattern, ignore_case)
    return cond if g is None else d.and_(g, cond)


def gated_extract(d, text, pattern, group, ignore_case=False, guard_text=None):
    """``regexp_extract`` ('' without a match), skipped when the required
    literals are absent."""
    ex = d.extract(text, pattern, group, ignore_case)
    g = gate(d, guard_text, pattern, ignore_case)
    return ex if g is None else d.case([(g, ex)], d.lit(""))


_CONTEXT_SENSITIVE = re.compile(r"\\[bBAZ]|[\^$]|\(\?[=!<]")


def group_reader(d, text, pattern, pre: dict, tag: str, ignore_case=False, guard_text=None):
    """A function ``g -> expr`` giving capture group ``g`` of the first match.

    For patterns without anchors, word boundaries or look-around, the long
    text is scanned once for the whole match (kept in ``pre``) and each group
    is read again from that short match: with no assertion about the
    surrounding text, the first match inside the match string is the same
    match, so the groups are identical.  Other patterns extract each group
    from the text.
    """
    if d.name != "spark" or _CONTEXT_SENSITIVE.search(pattern):
        return lambda g: gated_extract(d, text, pattern, g, ignore_case, guard_text)
    pre[tag] = gated_extract(d, text, pattern, 0, ignore_case, guard_text)
    return lambda g: d.extract(d.col(tag), pattern, g, ignore_case)


def chain(d, text, rules, ignore_case: bool = False, sql_type: str = "string", guard_text=None):
    """First matching rule's value, else NULL.  ``guard_text`` is the text
    the required-literal tests read: the same text for case-sensitive rules,
    a lower-cased and folded copy for case-insensitive ones."""
    return d.case([(matches(d, text, pat, ignore_case, guard_text), d.lit(val)) for pat, val in rules],
                  d.null(sql_type))


def neighbourhood(d, loc_text, prefilter: bool = False, guard_text=None):
    """Neighbourhood by rule order.  ``prefilter`` puts one alternation of
    all rules in front: identical result, cheaper when most texts match none."""
    expr = chain(d, loc_text, P.NEIGHBOURHOOD_RULES, ignore_case=True, guard_text=guard_text)
    if not prefilter:
        return expr
    union = "|".join(f"(?:{pat})" for pat, _ in P.NEIGHBOURHOOD_RULES)
    return d.case([(d.rlike(loc_text, union, True), expr)], d.null("string"))


def age_range(d, text, pre: dict, tag: str = "_age", guard_text=None, pre0: dict | None = None):
    """Adds the per-pattern numbers to ``pre`` (whole matches, when used, to
    ``pre0``, projected before ``pre``); returns (min, max) exprs."""
    pre0 = pre if pre0 is None else pre0
    lo_b, hi_b = P.AGE_BOUNDS
    lows, highs = [], []
    for i, pat in enumerate(P.AGE_RANGE_PATTERNS):
        lo_n, hi_n = f"{tag}_lo{i}", f"{tag}_hi{i}"
        group = group_reader(d, text, pat, pre0, f"{tag}_m{i}", guard_text=guard_text)
        pre[lo_n] = d.found_int(group(1))
        pre[hi_n] = d.found_int(group(2))
        lo, hi = d.col(lo_n), d.col(hi_n)
        ok = d.and_(d.between(lo, lo_b, hi_b), d.between(hi, lo_b, hi_b))
        lows.append((ok, lo))
        highs.append((ok, hi))
    return d.case(lows, d.null("int")), d.case(highs, d.null("int"))


def found_once(d, expr, pre0: dict, tag: str):
    """What a search of the long text found, as a column of its own (``pre0``)
    where the engine would else search again for every use of it."""
    if d.name != "spark":
        return expr
    pre0[tag] = expr
    return d.col(tag)


def min_lease_months(d, text, pre: dict, tag: str = "_lease", guard_text=None, pre0: dict | None = None):
    pre0 = pre if pre0 is None else pre0
    lo_b, hi_b = P.LEASE_MONTH_BOUNDS
    pairs = []
    for i, (pat, unit) in enumerate(P.MIN_LEASE_PATTERNS):
        name = f"{tag}_n{i}"
        pre[name] = d.found_bigint(found_once(d, gated_extract(d, text, pat, 1, guard_text=guard_text), pre0, f"{tag}_t{i}"))
        raw = d.col(name)
        # n * unit in [lo, hi]  <=>  n in [ceil(lo/unit), floor(hi/unit)];
        # testing n keeps huge numbers from overflowing the product.
        ok = d.between(raw, -(-lo_b // unit), hi_b // unit)
        pairs.append((ok, d.try_int(d.mul(raw, unit))))
    return d.case(pairs, d.null("int"))


def available_from(d, text, guard_text=None, pre0: dict | None = None):
    pre0 = {} if pre0 is None else pre0
    pat = P.AVAILABLE_MONTH_DATE_PATTERN
    g1 = group_reader(d, text, pat, pre0, "_avail_m0", guard_text=guard_text)
    month_day_year = d.concat(g1(1), d.lit(" "), g1(2), d.lit(" "), g1(3))
    by_name = d.coalesce(d.date_iso(month_day_year, "month_full"), d.date_iso(month_day_year, "month_abbr"))
    iso = P.AVAILABLE_ISO_DATE_PATTERN
    g2 = group_reader(d, text, iso, pre0, "_avail_m1", guard_text=guard_text)
    ymd = d.concat(g2(1), d.lit("-"), g2(2), d.lit("-"), g2(3))
    by_number = d.date_iso(ymd, "ymd")
    now = d.case([(matches(d, text, P.AVAILABLE_NOW_PATTERN, guard_text=guard_text), d.lit(P.AVAILABLE_NOW_VALUE))],
                 d.null("string"))
    return d.coalesce(by_name, by_number, now)


def price_range(d, raw_text, pre: dict, tag: str = "_prange", pre0: dict | None = None):
    pre0 = pre if pre0 is None else pre0
    lo_b, hi_b = P.PRICE_BOUNDS
    pat = P.PRICE_RANGE_PATTERN
    group = group_reader(d, raw_text, pat, pre0, f"{tag}_m", ignore_case=True)
    pre[f"{tag}_lo"] = d.found_int(d.replace(group(1), ",", ""))
    pre[f"{tag}_hi"] = d.found_int(d.replace(group(2), ",", ""))
    lo, hi = d.col(f"{tag}_lo"), d.col(f"{tag}_hi")
    ok = d.and_(d.between(lo, lo_b, hi_b), d.between(hi, lo_b, hi_b), d.lt(lo, hi))
    return d.case([(ok, lo)], d.null("int")), d.case([(ok, hi)], d.null("int"))


def transit_description(d, text, guard_text=None):
    # group 1 starts and ends with a word character, so the source's strip()
    # of the group never changes it
    return d.coalesce(*[d.nullif_empty(gated_extract(d, text, pat, 1, guard_text=guard_text))
                        for pat in P.TRANSIT_DESCRIPTION_PATTERNS])


def bedrooms(d, text, pre: dict, tag: str = "_beds"):
    lo_b, hi_b = P.ROOM_BOUNDS
    pre[tag] = d.try_int(d.coalesce(d.nullif_empty(d.extract(text, P.BEDROOM_PATTERN, 1)),
                                    d.nullif_empty(d.extract(text, P.BEDROOM_PATTERN, 2))))
    v = d.col(tag)
    return d.case([(d.between(v, lo_b, hi_b), v)], d.null("int"))


def bathrooms(d, text, pre: dict, tag: str = "_baths", pre0: dict | None = None):
    pre0 = pre if pre0 is None else pre0
    lo_b, hi_b = P.ROOM_BOUNDS
    pre[tag] = d.try_double(found_once(d, d.extract(text, P.BATHROOM_PATTERN, 1), pre0, f"{tag}_t"))
    v = d.col(tag)
    return d.case([(d.between(v, lo_b, hi_b), d.ceil_int(v))], d.null("int"))


def parsed_fields(d, text, raw_text, loc_text, prefilter_neighbourhood: bool = False,
                  word_text=None, word_loc=None, loc_fold=None) -> tuple[tuple[dict, dict], dict]:
    """All 37 derived columns as ``((pre0, pre), fields)``: ``pre0`` holds
    whole matches that several groups are read from, ``pre`` the numbers that
    range guards read twice (project ``pre0``, then ``pre``, then
    ``fields``).

    ``text``: lower-cased ``title || ' ' || description``; ``raw_text``: the
    same without lower-casing; ``loc_text``: ``location || ' ' || title ||
    ' ' || description``.
    """
    pre0: dict = {}   # whole matches, read by ``pre``
    pre: dict = {}
    out = {}
    # ``words``: the text for rules that test word boundaries (see
    # dialect.word_view); captured text is always read from ``text``.
    words = word_text if word_text is not None else text
    loc_words = word_loc if word_loc is not None else loc_text
    # required-literal guards read the same lower-cased text as the rules
    # (Spark only; the oracle runs every regex as written)
    guard = text if d.name == "spark" else None
    for name, rules in P.CHAIN_RULES.items():
        out[name] = chain(d, words, rules, sql_type=PARSED_TYPES[name], guard_text=guard)
    out["age_range_min"], out["age_range_max"] = age_range(d, words, pre, guard_text=guard, pre0=pre0)
    out["min_lease_months"] = min_lease_months(d, text, pre, guard_text=guard, pre0=pre0)
    out["available_from"] = available_from(d, text, guard_text=guard, pre0=pre0)
    out["price_min"], out["price_max"] = price_range(d, raw_text, pre, pre0=pre0)
    out["transit_description"] = transit_description(d, text, guard_text=guard)
    out["num_bedrooms"] = bedrooms(d, words, pre)
    out["num_bathrooms"] = bathrooms(d, words, pre, pre0=pre0)
    out["neighbourhood"] = neighbourhood(d, loc_words, prefilter_neighbourhood,
                                         guard_text=loc_fold if d.name == "spark" else None)
    return (pre0, pre), {name: out[name] for name, _ in PARSED_COLUMNS}


# --------------------------------------------------------------------------
# General cleaning and parsing helpers (H1, H3, H5-H8)
# --------------------------------------------------------------------------
def clean_text(d, x):
    """Collapse every run of whitespace (incl. NBSP) to one space, strip; NULL -> ''."""
    return d.strip(d.one_space(d.coalesce(x, d.lit(""))))


def extract_price(d, price_text, staged: tuple[dict, dict] | None = None):
    """Monthly price: each pattern's first match in turn, commas dropped, in
    bounds.  With ``staged`` the matches and the numbers are columns, added to
    the two stages given, so that each is found once."""
    lo_b, hi_b = P.PRICE_BOUNDS
    pairs = []
    for i, pat in enumerate(P.PRICE_PATTERNS):
        found = d.replace(d.extract(price_text, pat, 1, True), ",", "")
        if staged:
            staged[0][f"_price_t{i}"] = found
            found = d.col(f"_price_t{i}")
        v = d.found_int(found)
        if staged:
            staged[1][f"_price_n{i}"] = v
            v = d.col(f"_price_n{i}")
        pairs.append((d.between(v, lo_b, hi_b), v))
    return d.case(pairs, d.null("int"))
