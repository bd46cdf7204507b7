"""Text enrichment: 37 derived columns plus the merge with captured values.

``enrich(listings)`` is one narrow projection (no shuffle): a ``lower`` of
title + description is computed once, every rule is a native column
expression, and the merge rules decide between captured and parsed values:

* ``utilities_included``, ``parking_included``, ``pets_allowed``,
  ``num_bedrooms``, ``num_bathrooms``: the captured value wins when set;
* every other derived column: the parsed value wins when not NULL;
* ``furnished`` (when not captured): true if bedroom or common areas are
  furnished, else false for ``unfurnished``, else true for a fully or
  partially furnished level;
* ``laundry_in_unit`` (when not captured): true for ``in_unit`` laundry;
* facebook (model-answer) rows only get the neighbourhood rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.functions.dialect import DUCK, SPARK
from rentgrid.functions.extract import PARSED_COLUMNS, parsed_fields
from rentgrid.functions.prefilter import DOTTED_I, FOLD_FROM, FOLD_TO
from rentgrid.functions.stages import apply_stages, cached, stages_sql
from rentgrid.schema import CAPTURED_FIRST, LISTING_COLUMNS

TEXT_COL = "_text_lc"


def fold_column(loc: F.Column) -> F.Column:
    """Lower-cased location text for the neighbourhood literal guards, with
    the few characters that only match ASCII letters under Unicode case
    folding mapped to them."""
    return F.replace(F.translate(F.lower(loc), FOLD_FROM, FOLD_TO), F.lit(DOTTED_I), F.lit("i"))


def text_columns(d):
    """Helper columns the rules read: lower-cased and raw title+description,
    and location+title+description for the neighbourhood."""
    # a missing text is an empty one: NULL would blank the other's columns too
    title, description, location = (d.coalesce(d.col(c), d.lit("")) for c in ("title", "description", "location"))
    raw = d.concat(title, d.lit(" "), description)
    return {
        TEXT_COL: d.lower(raw),
        "_text_raw": raw,
        "_text_loc": d.concat(location, d.lit(" "), title, d.lit(" "), description),
    }


def enrich_stages(d, prefilter_neighbourhood: bool = False, extra: tuple[str, ...] = ()) -> tuple[list[dict], dict]:
    """(stages, final projection) over a relation with the listing columns;
    ``extra`` columns pass through unchanged."""
    s1 = text_columns(d)
    spark = d.name == "spark"
    s1w = {"_loc_fold": fold_column(d.col("_text_loc"))} if spark else \
        {"_text_w": d.word_view(d.col(TEXT_COL)), "_loc_w": d.word_view(d.col("_text_loc"))}
    pre, parsed = parsed_fields(d, d.col(TEXT_COL), d.col("_text_raw"), d.col("_text_loc"),
                                prefilter_neighbourhood,
                                None if spark else d.col("_text_w"), None if spark else d.col("_loc_w"),
                                d.col("_loc_fold") if spark else None)
    s2 = {f"_p_{name}": expr for name, expr in parsed.items()}
    is_post = d.eq(d.col("source"), "facebook")
    s3 = {}
    for name, _ in PARSED_COLUMNS:
        captured, value = d.col(name), d.col(f"_p_{name}")
        if name == "neighbourhood":
            s3[f"_m_{name}"] = d.case([(is_post, value)], d.coalesce(value, captured))
        elif name in CAPTURED_FIRST:
            s3[f"_m_{name}"] = d.case([(is_post, captured)], d.coalesce(captured, value))
        else:
            s3[f"_m_{name}"] = d.case([(is_post, captured)], d.coalesce(value, captured))
    m = lambda n: d.col(f"_m_{n}")
    furnished_parts = d.or_(d.coalesce(m("furnished_bedroom"), d.lit(False)),
                            d.coalesce(m("furnished_common"), d.lit(False)))
    derived_furnished = d.case([
        (furnished_parts, d.lit(True)),
        (d.eq(m("furniture_level"), "unfurnished"), d.lit(False)),
        (d.isin(m("furniture_level"), ("fully_furnished", "partially_furnished")), d.lit(True)),
    ], d.null("boolean"))
    derived_laundry = d.case([(d.eq(m("laundry_type"), "in_unit"), d.lit(True))], d.null("boolean"))
    final = {}
    parsed_names = {n for n, _ in PARSED_COLUMNS}
    for name in LISTING_COLUMNS:
        if name in parsed_names:
            final[name] = m(name)
        elif name == "furnished":
            final[name] = d.case([(is_post, d.col(name))], d.coalesce(d.col(name), derived_furnished))
        elif name == "laundry_in_unit":
            final[name] = d.case([(is_post, d.col(name))], d.coalesce(d.col(name), derived_laundry))
        else:
            final[name] = d.col(name)
    for name in extra:
        final[name] = d.col(name)
    stages = [s1, s1w, pre[0], pre[1], s2, s3]
    return stages, final


def enrich(listings: DataFrame, prefilter_neighbourhood: bool = False) -> DataFrame:
    """Add the derived columns to a listing DataFrame (narrow, no shuffle)."""
    extra = tuple(c for c in listings.columns if c not in LISTING_COLUMNS)
    stages, final = cached(("enrich", prefilter_neighbourhood, extra),
                           lambda: enrich_stages(SPARK, prefilter_neighbourhood, extra))
    return apply_stages(listings, stages, final)


def enrich_sql(listing_relation: str) -> str:
    stages, final = enrich_stages(DUCK, extra=("listing_key", "snapshot_no"))
    return stages_sql(listing_relation, stages, final)


def parse_text(df: DataFrame, title: str, description: str, location: str | None = None,
               prefilter_neighbourhood: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Only the 37 parsed columns for any text columns (no merge), plus the
    ``keep`` columns.  Used for free text such as ``documents``."""
    keep = keep if keep is not None else df.columns
    loc = F.coalesce(F.col(location), F.lit("")) if location else F.lit("")
    raw = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(description), F.lit("")))
    staged = df.select(*keep, F.lower(raw).alias(TEXT_COL), raw.alias("_text_raw"),
                       F.concat(loc, F.lit(" "), raw).alias("_text_loc"))
    staged = staged.select("*", fold_column(F.col("_text_loc")).alias("_loc_fold"))
    pre, parsed = cached(("parse_text", prefilter_neighbourhood), lambda: parsed_fields(
        SPARK, F.col(TEXT_COL), F.col("_text_raw"), F.col("_text_loc"), prefilter_neighbourhood,
        loc_fold=F.col("_loc_fold")))
    final = {c: F.col(c) for c in keep}
    final.update(parsed)
    return apply_stages(staged, [pre[0], pre[1]], final)


def parse_text_sql(relation: str, title_sql: str, description_sql: str, keep: list[str]) -> str:
    """DuckDB form of :func:`parse_text` (oracle)."""
    d = DUCK
    raw = f"(coalesce({title_sql}, '') || ' ' || coalesce({description_sql}, ''))"
    s1 = {TEXT_COL: f"lower({raw})", "_text_raw": raw, "_text_loc": f"('' || ' ' || {raw})"}
    s1w = {"_text_w": d.word_view(TEXT_COL), "_loc_w": d.word_view("_text_loc")}
    pre, parsed = parsed_fields(d, TEXT_COL, "_text_raw", "_text_loc", word_text="_text_w", word_loc="_loc_w")
    final = {c: c for c in keep}
    final.update(parsed)
    return stages_sql(relation, [s1, s1w, pre[0], pre[1]], final)
