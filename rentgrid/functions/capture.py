"""Capture clean-up functions (dates, ids, urls, listing type, detail flags).

All are dialect-generic column expressions (see ``dialect.py``).
"""

from __future__ import annotations

from rentgrid.functions import patterns as P
from rentgrid.functions.dates import free_date_stages


def relative_date_stages(d, text, as_of, prefix: str = "_rd"):
    """'2 hours ago', 'an hour ago', 'just now', 'today', 'yesterday' -> timestamp.

    Returns projection stages (each a ``{column: expr}``; later stages read
    earlier columns) whose last stage yields ``{prefix}``.  ``as_of`` stands
    for "now"; a month counts 30 days.  Text that is not relative is read as
    it stands, as an ISO timestamp or one of the written forms of
    ``dialect.DATE_FORMS``, else by the grammar of ``dates``.  An offset that
    leaves the timestamp range, whatever its unit, gives NULL.
    """
    t, t1, amount, unit = (f"{prefix}_t", f"{prefix}_t1", f"{prefix}_n", f"{prefix}_unit")
    rel = "^" + P.RELATIVE_DATE_PATTERN
    raw = f"{prefix}_raw"
    s0 = {raw: d.strip(text), f"{prefix}_empty": d.eq(text, "")}
    s1 = {t: d.lower(d.col(raw))}
    s2 = {t1: d.regexp_replace(d.col(t), P.ARTICLE_PATTERN, "1")}
    s3 = {amount: d.try_bigint(d.nullif_empty(d.extract(d.col(t1), rel, 1))),
          unit: d.extract(d.col(t1), rel, 2)}
    unit_secs = d.case([(d.eq(d.col(unit), u), d.lit(s)) for u, s in P.RELATIVE_UNIT_SECONDS.items()],
                       d.null("bigint"))
    # about 1,965 years, in any unit: beyond that there is no such timestamp
    in_range = d.or_(*[d.and_(d.eq(d.col(unit), u), d.le(d.col(amount), 62_000_000_000 // s))
                       for u, s in P.RELATIVE_UNIT_SECONDS.items()])
    relative = d.or_(d.isin(d.col(t), (*P.RELATIVE_NOW_WORDS, "today", "yesterday", "")), d.not_(d.is_null(d.col(amount))))
    free = free_date_stages(d, d.case([(d.not_(relative), d.col(t1))], d.null("string")), as_of, f"{prefix}_free")
    last = {prefix: d.case([
        (d.col(f"{prefix}_empty"), d.null("timestamp")),
        (d.isin(d.col(t), P.RELATIVE_NOW_WORDS), as_of),
        (d.eq(d.col(t), "today"), d.day_start(as_of)),
        (d.eq(d.col(t), "yesterday"), d.day_start(as_of, 1)),
        (d.and_(d.not_(d.is_null(d.col(amount))), in_range), d.minus_seconds(as_of, d.mul_col(d.col(amount), unit_secs))),
        (d.not_(d.is_null(d.col(amount))), d.null("timestamp")),
    ], d.coalesce(d.try_iso_timestamp(d.col(raw)), d.try_named_date(d.col(raw)), d.col(f"{prefix}_free")))}
    return [s0, s1, s2, s3, *free, last]


def iso_timestamp(d, text):
    """ISO-8601 text (``Z`` allowed) -> timestamp, else NULL."""
    return d.try_iso_timestamp(text)


def absolute_url(d, href, base):
    return d.case([(d.eq(href, ""), d.lit("")), (d.startswith(href, "http"), href)],
                  d.concat(d.lit(base), href))


def id_from_url(d, url, pattern, prefix):
    digits = d.nullif_empty(d.extract(url, pattern, 1))
    return d.case([(d.not_(d.is_null(digits)), d.concat(d.lit(prefix), digits))], d.null("string"))


def strip_qr_boilerplate(d, text):
    return d.regexp_replace(text, P.QR_BOILERPLATE_PATTERN, "", ignore_case=True)


def classify_listing_type(d, text_lower, current, rules):
    """First rule whose any phrase occurs in the text; no hit keeps ``current``."""
    pairs = [(d.or_(*[d.contains(text_lower, w) for w in words]), d.lit(label)) for words, label in rules]
    return d.case(pairs, current)


def map_listing_type(d, value):
    """Known listing type strings pass, everything else becomes 'other'."""
    return d.case([(d.isin(value, P.LISTING_TYPES), value)], d.lit("other"))


def craigslist_attr_flags(d, attrs):
    """Detail attributes of the first site: substring tests on the joined,
    lower-cased blob (so 'unfurnished' also counts as furnished)."""
    blob = d.array_join(d.transform_arr(attrs, lambda a: d.lower(a)), " ")
    yes = d.lit(True)
    no = d.null("boolean")
    has = lambda *ws: d.or_(*[d.contains(blob, w) for w in ws])
    return {
        "furnished": d.case([(has("furnished"), yes)], no),
        "pets_allowed": d.case([(has("cats", "dogs", "pets"), yes)], no),
        "laundry_in_unit": d.case([(has("laundry in unit", "w/d in unit"), yes)], no),
        "parking_included": d.case([(has("parking", "carport", "garage"), yes)], no),
        "utilities_included": no,
        "square_feet": d.try_int(d.last_elem(d.filter_arr(
            d.transform_arr(attrs, lambda a: d.nullif_empty(d.extract(d.lower(a), P.CRAIGSLIST_SQFT_PATTERN, 1))),
            lambda v: d.not_(d.is_null(v))))),
    }


def kijiji_attr_flags(d, attrs):
    """Detail attribute rows of the second site: per row an if/elif chain,
    then OR over rows; a row counts only for its first matching branch."""
    def branch_conds(row):
        t = d.lower(row)
        c_furn = d.contains(t, "furnished")
        c_pet = d.and_(d.contains(t, "pet"), d.contains(t, "yes"))
        c_park = d.and_(d.contains(t, "parking"), d.contains(t, "yes"))
        c_laundry = d.and_(d.contains(t, "laundry"), d.or_(d.contains(t, "unit"), d.contains(t, "suite")))
        c_util = d.and_(d.contains(t, "utilities"), d.or_(d.contains(t, "included"), d.contains(t, "yes")))
        return [c_furn, c_pet, c_park, c_laundry, c_util]

    def nth_branch(i):
        def fn(row):
            conds = branch_conds(row)
            earlier = [d.not_(c) for c in conds[:i]]
            return d.and_(*(earlier + [conds[i]])) if earlier else conds[i]
        return fn

    yes = d.lit(True)
    no = d.null("boolean")
    names = ["furnished", "pets_allowed", "parking_included", "laundry_in_unit", "utilities_included"]
    out = {name: d.case([(d.exists_arr(attrs, nth_branch(i)), yes)], no) for i, name in enumerate(names)}
    out["square_feet"] = d.try_int(d.last_elem(d.filter_arr(
        d.transform_arr(attrs, lambda a: d.nullif_empty(d.extract(d.lower(a), P.KIJIJI_SQFT_PATTERN, 1))),
        lambda v: d.not_(d.is_null(v)))))
    return out


def coordinates(d, lat_text, lon_text):
    """Detail-page coordinates: read only when both texts are present; the
    latitude is read first, so a bad latitude leaves both NULL while a bad
    longitude still keeps the latitude."""
    both = d.and_(d.ne(lat_text, ""), d.ne(lon_text, ""))
    lat = d.try_double(lat_text)
    lat_out = d.case([(both, lat)], d.null("double"))
    lon_out = d.case([(d.and_(both, d.not_(d.is_null(lat))), d.try_double(lon_text))], d.null("double"))
    return lat_out, lon_out


def http_images(d, images, drop_placeholder: bool = False):
    keep = (lambda s: d.and_(d.startswith(s, "http"), d.not_(d.contains(s, "placeholder")))) if drop_placeholder \
        else (lambda s: d.startswith(s, "http"))
    return d.filter_arr(images, keep)
