"""Dates as people write them: 'Nov 5', 'Thu Nov 5', 'Tuesday', 'November 3rd,
2026', '5 Nov 3:45 pm', '11/5', '2026-11', '10:15'.

A text is a set of parts in any order (weekday, date, time) with commas, dots
behind words, ordinal endings and the words at, on, of, and between them.
What a text leaves out comes from the day of ``as_of``, with the time 00:00; a
day that the month does not have becomes its last one, if the text gave no
day.  A weekday alone is the next such day, that of ``as_of`` included; next
to a day it says nothing.  Numbers are month first, unless that cannot be.  A
text with anything else in it is no date.
"""

from __future__ import annotations

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_MONTH = (r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?"
          r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b")
_WEEKDAY = r"\b(mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b"
_CLOCK = r"\b([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([ap])m?\b)?"
_HOUR = r"\b([0-9]{1,2}) ?([ap])m\b"
_YEAR = "[0-9]{4}|[0-9]{2}"
#: Dates with a month's name (written M), and in numbers.
_MONTH_FIRST = rf"^(?:([0-9]{{4}}) )?M(?: ([0-9]{{1,2}}))?(?: ({_YEAR}))?$"
_DAY_FIRST = rf"^([0-9]{{1,2}}) M(?: ({_YEAR}))?$"
_NUMBERS = rf"^([0-9]{{1,2}})[-/]([0-9]{{1,2}})(?:[-/]({_YEAR}))?$"
_DOTS = rf"^([0-9]{{1,2}})[.]([0-9]{{1,2}})[.]({_YEAR})$"
_YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})(?:[-/.]([0-9]{1,2}))?$"


def free_date_stages(d, text, as_of, prefix: str) -> list[dict]:
    """Projection stages whose last one yields ``{prefix}``; ``text`` is
    lower-cased, NULL for texts that need not be read."""
    name = lambda part: f"{prefix}_{part}"
    col = lambda part: d.col(name(part))
    got = lambda source, pattern, group: d.try_int(d.nullif_empty(d.extract(source, pattern, group)))
    none = lambda x: d.is_null(x)
    some = lambda x: d.not_(d.is_null(x))

    s = col("s")
    spaced = d.regexp_replace(d.regexp_replace(text, r"[,;]", " "), r"([a-z])[.]", "$1" if d.name == "spark" else r"\1")
    stages = [{name("s"): spaced}]
    clock, hour = d.extract(s, _CLOCK, 0), d.extract(s, _HOUR, 0)
    has_clock, has_hour = d.ne(clock, ""), d.ne(hour, "")
    bare = d.regexp_replace(d.regexp_replace(d.regexp_replace(s, _CLOCK, " "), _HOUR, " "), _WEEKDAY, " ")
    plain = d.regexp_replace(d.regexp_replace(bare, r"\b(?:at|on|of|and)\b", " "), r"\b([0-9]{1,2})(?:st|nd|rd|th)\b", "$1" if d.name == "spark" else r"\1")
    stages.append({
        name("h"): d.case([(has_clock, got(s, _CLOCK, 1)), (has_hour, got(s, _HOUR, 1))], d.lit(0)),
        name("mi"): d.case([(has_clock, got(s, _CLOCK, 2))], d.lit(0)),
        name("se"): d.case([(has_clock, d.coalesce(got(s, _CLOCK, 3), d.lit(0)))], d.lit(0)),
        name("ap"): d.case([(has_clock, d.extract(s, _CLOCK, 4)), (has_hour, d.extract(s, _HOUR, 2))], d.lit("")),
        name("timed"): d.or_(has_clock, has_hour),
        name("wd"): d.substr(d.extract(s, _WEEKDAY, 1), 1, 3),
        name("mon"): d.substr(d.extract(plain, _MONTH, 1), 1, 3),
        name("rest"): d.strip(d.regexp_replace(d.regexp_replace(plain, _MONTH, "M"), r"\s+", " ")),
    })
    named = d.ne(col("mon"), "")
    stages.append({name("r"): d.case([(named, d.strip(d.regexp_replace(col("rest"), "[-/. ]+", " ")))], col("rest"))})
    r = col("r")
    forms = {k: d.ne(d.extract(r, p, 0), "") for k, p in (
        ("mf", _MONTH_FIRST), ("df", _DAY_FIRST), ("nu", _NUMBERS), ("do", _DOTS), ("yf", _YEAR_FIRST))}
    first = d.case([(forms["nu"], got(r, _NUMBERS, 1))], got(r, _DOTS, 1))
    second = d.case([(forms["nu"], got(r, _NUMBERS, 2))], got(r, _DOTS, 2))
    month = d.case([(d.eq(col("mon"), m), d.lit(i + 1)) for i, m in enumerate(MONTHS)], d.null("int"))
    numbers = d.or_(forms["nu"], forms["do"])
    swapped = d.and_(numbers, d.lt(d.lit(12), first))
    alone = d.and_(d.eq(r, ""), d.or_(d.ne(col("wd"), ""), col("timed")))
    two_years = d.and_(forms["mf"], some(got(r, _MONTH_FIRST, 1)), some(got(r, _MONTH_FIRST, 3)))
    stages.append({
        name("ok"): d.and_(d.or_(alone, *forms.values()), d.not_(two_years)),
        name("y"): d.case([(forms["mf"], d.coalesce(got(r, _MONTH_FIRST, 1), got(r, _MONTH_FIRST, 3))),
                           (forms["df"], got(r, _DAY_FIRST, 2)), (forms["nu"], got(r, _NUMBERS, 3)), (forms["do"], got(r, _DOTS, 3)),
                           (forms["yf"], got(r, _YEAR_FIRST, 1))], d.null("int")),
        name("m"): d.case([(swapped, second), (numbers, first), (forms["yf"], got(r, _YEAR_FIRST, 2)), (named, month)], d.null("int")),
        name("d"): d.case([(forms["mf"], got(r, _MONTH_FIRST, 2)), (forms["df"], got(r, _DAY_FIRST, 1)), (swapped, first),
                           (numbers, second), (forms["yf"], got(r, _YEAR_FIRST, 3))], d.null("int")),
    })
    now_year = d.part(as_of, "year")
    far = lambda k: d.add(now_year, d.lit(k))
    near = d.add(col("y"), d.add(now_year, d.neg(d.mod(now_year, 100))))  # two digits: this century's
    year = d.case([(none(col("y")), now_year), (d.lt(d.lit(99), col("y")), col("y")), (d.lt(far(49), near), d.add(near, d.lit(-100))),
                   (d.lt(near, far(-50)), d.add(near, d.lit(100)))], near)
    twelve = d.case([(d.eq(col("h"), 12), d.lit(0))], col("h"))
    hour24 = d.case([(d.eq(col("ap"), ""), col("h")), (d.lt(d.lit(12), col("h")), d.lit(99)), (d.eq(col("ap"), "p"), d.add(twelve, d.lit(12)))], twelve)
    stages.append({name("yy"): year, name("mm"): d.coalesce(col("m"), d.part(as_of, "month")), name("hh"): hour24})
    two = lambda x: d.lpad(d.to_str(x), 2, "0")

    def at(day):
        return d.try_iso_timestamp(d.concat(
            d.lpad(d.to_str(col("yy")), 4, "0"), d.lit("-"), two(col("mm")), d.lit("-"), two(day), d.lit(" "),
            two(col("hh")), d.lit(":"), two(col("mi")), d.lit(":"), two(col("se"))))
    today = d.part(as_of, "day")
    # without a day: that of as_of, or the last one that the month has
    default = d.coalesce(*[at(d.case([(d.lt(d.lit(last), today), d.lit(last))], today)) for last in (31, 30, 29, 28)])
    stages.append({name("at"): d.case([(d.not_(col("ok")), d.null("timestamp")), (some(col("d")), at(col("d")))], default)})
    wanted = d.case([(d.eq(col("wd"), w), d.lit(i)) for i, w in enumerate(WEEKDAYS)], d.null("int"))
    ahead = d.mod(d.add(wanted, d.add(d.lit(7), d.neg(d.weekday(col("at"))))), 7)
    stages.append({prefix: d.case([(d.and_(none(col("d")), some(wanted)), d.plus_hours(col("at"), d.mul(ahead, 24)))], col("at"))})
    return stages
