"""One expression vocabulary, two back ends.

Every derived column is written once against a small interface (``d.rlike``,
``d.extract``, ``d.case`` ...).  :class:`SparkDialect` turns it into native
Spark ``Column`` expressions (JVM side, whole-stage codegen, no Python per
row); :class:`DuckDialect` turns the same definition into DuckDB SQL text,
which is how ``oracle_sql()`` is produced.

The patterns in :mod:`rentgrid.functions.patterns` are written for Python's
``re``.  Three dialect points keep the match sets equal:

* ``\\s``: Python matches every ``str.isspace`` character; Java and RE2 only
  ASCII ones.  ``\\s`` is rewritten to the explicit Python set.
* ``\\uXXXX`` is not understood by RE2; ``\\x{XXXX}`` means the same in Java
  and RE2.
* ``.``: Python excludes only ``\\n``; Java also excludes ``\\r`` and other
  line ends unless ``(?d)`` is set; RE2 already behaves like Python.
* case-insensitive patterns: Python folds Unicode case, so Java gets
  ``(?iu)``; RE2's ``(?i)`` is Unicode-aware already.

Known residual difference: RE2's ``\\b`` is ASCII-only while Python and Java
(17) treat accented letters as word characters.  It only matters when a rule
word touches a non-ASCII letter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace set (str.isspace), as class contents valid in Java and RE2.
PY_SPACE_CHARS = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

#: The same characters as text, and those of ASCII but the space as class contents.
PY_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
ASCII_ODD_SPACES = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"

#: ISO-8601: a whole date, and a time of at least hours and minutes if any.
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
ISO_BASIC_PATTERN = r"^\d{8}$"
#: The same without separators, with hours, minutes and perhaps seconds.
ISO_COMPACT_PATTERN = r"^\d{8}T\d{4}(\d{2})?$"
#: Written dates that are read: (pattern, Java format, C format).
DATE_FORMS = (
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy", "%b %d, %Y"),
    (r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}$", "MMMM d, yyyy", "%B %d, %Y"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy", "%d %b %Y"),
    (r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}$", "d MMMM yyyy", "%d %B %Y"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy", "%m/%d/%Y"),
)

_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def _portable(pattern: str) -> str:
    """Rewrite ``\\s`` and ``\\uXXXX`` so Java and RE2 match what Python matches."""
    pattern = _UNICODE_ESCAPE.sub(lambda m: r"\x{" + m.group(1) + "}", pattern)
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(PY_SPACE_CHARS if in_class else "[" + PY_SPACE_CHARS + "]")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            # a leading ']' or '^]' is literal
            if pattern[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1:i + 2] == "]":
                out.append("]")
                i += 1
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iud)" if ignore_case else "(?d)") + _portable(pattern)


def re2_regex(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _portable(pattern)


# Leading/trailing whitespace, as Python's ``str.strip()`` removes it.
STRIP_PATTERN = r"^\s+|\s+$"
#: A run of white space, NBSP included.
SPACES_PATTERN = r"[\s\xa0]+"


# --------------------------------------------------------------------------
class SparkDialect:
    """Builds native Spark Column expressions."""

    name = "spark"

    def col(self, name: str) -> Column:
        return F.col(name)

    def lit(self, value) -> Column:
        return F.lit(value)

    def null(self, sql_type: str) -> Column:
        return F.lit(None).cast(sql_type)

    def rlike(self, x: Column, pattern: str, ignore_case: bool = False) -> Column:
        return x.rlike(java_regex(pattern, ignore_case))

    def extract(self, x: Column, pattern: str, group: int, ignore_case: bool = False) -> Column:
        return F.regexp_extract(x, java_regex(pattern, ignore_case), group)

    def regexp_replace(self, x: Column, pattern: str, repl: str, ignore_case: bool = False) -> Column:
        return F.regexp_replace(x, java_regex(pattern, ignore_case), repl)

    def case(self, pairs, default: Column | None = None) -> Column:
        expr = None
        for cond, value in pairs:
            expr = F.when(cond, value) if expr is None else expr.when(cond, value)
        return expr.otherwise(default) if default is not None else expr

    def coalesce(self, *xs: Column) -> Column:
        return F.coalesce(*xs)

    def nullif_empty(self, x: Column) -> Column:
        return F.nullif(x, F.lit(""))

    def try_int(self, x: Column) -> Column:
        return x.try_cast("int")

    def try_bigint(self, x: Column) -> Column:
        return x.try_cast("bigint")

    def try_double(self, x: Column) -> Column:
        # text without a digit is no number, unless it names one of the special values
        return F.when(x.rlike("(?i)[0-9]|nan|inf"), x.try_cast("double"))

    # A cast that fails raises and catches an exception, which costs more than
    # a pattern search: what a pattern did not find ('') is not cast.
    def found_int(self, x: Column) -> Column:
        """``try_int`` of a group of digits, '' without a match."""
        return F.when(x != "", x.try_cast("int"))

    def found_bigint(self, x: Column) -> Column:
        return F.when(x != "", x.try_cast("bigint"))

    def between(self, x: Column, lo, hi) -> Column:
        return (x >= lo) & (x <= hi)

    def and_(self, *cs: Column) -> Column:
        out = cs[0]
        for c in cs[1:]:
            out = out & c
        return out

    def or_(self, *cs: Column) -> Column:
        out = cs[0]
        for c in cs[1:]:
            out = out | c
        return out

    def not_(self, c: Column) -> Column:
        return ~c

    def eq(self, x: Column, y) -> Column:
        return x == y

    def lt(self, x: Column, y: Column) -> Column:
        return x < y

    def lower(self, x: Column) -> Column:
        return F.lower(x)

    def concat(self, *xs: Column) -> Column:
        return F.concat(*xs)

    def replace(self, x: Column, search: str, repl: str) -> Column:
        return F.replace(x, F.lit(search), F.lit(repl))

    def ceil_int(self, x: Column) -> Column:
        return F.ceil(x).cast("int")

    def mul(self, x: Column, k: int) -> Column:
        return x * F.lit(k)

    def mul_col(self, x: Column, y: Column) -> Column:
        return x * y

    def date_iso(self, x: Column, fmt: str) -> Column:
        """Parse ``x`` with a named format; ISO ``yyyy-MM-dd`` text or NULL."""
        spark_fmt = {"month_full": "MMMM d yyyy", "month_abbr": "MMM d yyyy", "ymd": "yyyy-M-d"}[fmt]
        # text without a digit (no match) is no date: parsing it would raise
        return F.date_format(F.try_to_date(F.when(x.rlike("[0-9]"), x), spark_fmt), "yyyy-MM-dd")

    def contains(self, x: Column, s: str) -> Column:
        return x.contains(s)

    def strip(self, x: Column) -> Column:
        # as STRIP_PATTERN does, without a search for white space through the whole text
        return F.btrim(x, F.lit(PY_SPACES))

    def one_space(self, x: Column) -> Column:
        """Every run of white space as one space.  Only a text that holds other
        runs than single spaces is rewritten."""
        ascii_only = F.octet_length(x) == F.char_length(x)
        odd = x.contains("  ") | ~ascii_only | x.rlike(f"[{ASCII_ODD_SPACES}]")
        return F.when(odd, self.regexp_replace(x, SPACES_PATTERN, " ")).otherwise(x)

    def contains_any(self, x: Column, literals) -> Column:
        out = None
        for lit in literals:
            c = x.contains(lit)
            out = c if out is None else (out | c)
        return out

    def word_view(self, x: Column) -> Column:
        """Text as seen by word-boundary rules; Java's \\b already treats
        accented letters as word characters, like Python."""
        return x

    # -- fixture and plumbing helpers --
    def pick(self, key: Column, values: list[str]) -> Column:
        """values[key mod len(values)]"""
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))

    def mod(self, x: Column, k: int) -> Column:
        return F.pmod(x, F.lit(k))

    def idiv(self, x: Column, k: int) -> Column:
        return F.floor(x / F.lit(k)).cast("bigint")

    def to_str(self, x: Column) -> Column:
        return x.cast("string")

    def lpad(self, x: Column, n: int, pad: str) -> Column:
        return F.lpad(x, n, pad)

    def concat_ws(self, sep: str, *xs: Column) -> Column:
        return F.concat_ws(sep, *xs)

    def sha_id(self, prefix: str, *xs: Column) -> Column:
        return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\u0001", *xs), 256))

    def add(self, x: Column, y: Column) -> Column:
        return x + y

    def neg(self, x: Column) -> Column:
        return -x

    # -- arrays (higher-order functions run inside codegen, no Python) --
    def filter_arr(self, arr: Column, fn) -> Column:
        return F.filter(arr, fn)

    def exists_arr(self, arr: Column, fn) -> Column:
        return F.exists(arr, fn)

    def transform_arr(self, arr: Column, fn) -> Column:
        return F.transform(arr, fn)

    def last_elem(self, arr: Column) -> Column:
        return F.try_element_at(arr, F.lit(-1))

    def first_elem(self, arr: Column) -> Column:
        return F.try_element_at(arr, F.lit(1))

    def array_join(self, arr: Column, sep: str) -> Column:
        return F.array_join(arr, sep)

    def size(self, x: Column) -> Column:
        return F.size(x)

    def slice_arr(self, arr: Column, start: int, n: int) -> Column:
        return F.slice(arr, start, n)

    def to_int(self, x: Column) -> Column:
        return x.cast("int")

    def le(self, x: Column, y) -> Column:
        return x <= y

    def split(self, x: Column, sep: str) -> Column:
        """Split on a literal separator; '' gives an empty array."""
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, re.escape(sep)))

    def ge(self, x: Column, y) -> Column:
        return x >= y

    def ne(self, x: Column, y) -> Column:
        return x != y

    def isin(self, x: Column, values) -> Column:
        return x.isin(list(values))

    def is_null(self, x: Column) -> Column:
        return x.isNull()

    def startswith(self, x: Column, s: str) -> Column:
        return x.startswith(s)

    def btrim(self, x: Column, chars: str) -> Column:
        return F.btrim(x, F.lit(chars))

    def length(self, x: Column) -> Column:
        return F.length(x)

    def substr(self, x: Column, start: int, n: int) -> Column:
        return F.substring(x, start, n)

    def try_iso_timestamp(self, x: Column) -> Column:
        """ISO-8601 text with a whole date, extended or basic, else NULL."""
        return F.when(x.rlike(ISO_PATTERN), F.try_to_timestamp(x)).when(
            x.rlike(ISO_BASIC_PATTERN), F.try_to_timestamp(x, F.lit("yyyyMMdd"))).when(
            x.rlike(ISO_COMPACT_PATTERN), F.try_to_timestamp(F.rpad(x, 15, "0"), F.lit("yyyyMMdd'T'HHmmss")))

    def part(self, ts: Column, unit: str) -> Column:
        return {"year": F.year, "month": F.month, "day": F.day}[unit](ts)

    def weekday(self, ts: Column) -> Column:
        """Monday is 0."""
        return F.weekday(ts)

    def try_named_date(self, x: Column) -> Column:
        """A date in one of the written forms, else NULL."""
        return F.coalesce(*[F.when(x.rlike(pattern), F.try_to_timestamp(x, F.lit(java)))
                            for pattern, java, _ in DATE_FORMS])

    def minus_seconds(self, ts: Column, secs: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(ts) - secs * F.lit(1_000_000))

    def day_start(self, ts: Column, days_back: int = 0) -> Column:
        return F.date_trunc("day", ts) - F.expr(f"INTERVAL {days_back} DAYS") if days_back else F.date_trunc("day", ts)

    def ts_lit(self, iso: str) -> Column:
        return F.to_timestamp(F.lit(iso))

    def plus_hours(self, ts: Column, hours: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(ts) + hours * F.lit(3_600_000_000))


# --------------------------------------------------------------------------
def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class DuckDialect:
    """Builds DuckDB SQL text with the same meaning (used for the oracle)."""

    name = "duckdb"

    def col(self, name: str) -> str:
        return name

    def lit(self, value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, (int, float)):
            return repr(value)
        return sql_str(str(value))

    def null(self, sql_type: str) -> str:
        t = {"int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
             "bigint": "BIGINT", "timestamp": "TIMESTAMP"}[sql_type]
        return f"CAST(NULL AS {t})"

    def rlike(self, x: str, pattern: str, ignore_case: bool = False) -> str:
        return f"regexp_matches({x}, {sql_str(re2_regex(pattern, ignore_case))})"

    def extract(self, x: str, pattern: str, group: int, ignore_case: bool = False) -> str:
        return f"regexp_extract({x}, {sql_str(re2_regex(pattern, ignore_case))}, {group})"

    def regexp_replace(self, x: str, pattern: str, repl: str, ignore_case: bool = False) -> str:
        return f"regexp_replace({x}, {sql_str(re2_regex(pattern, ignore_case))}, {sql_str(repl)}, 'g')"

    def case(self, pairs, default: str | None = None) -> str:
        body = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
        tail = f" ELSE {default}" if default is not None else ""
        return f"CASE {body}{tail} END"

    def coalesce(self, *xs: str) -> str:
        return f"COALESCE({', '.join(xs)})"

    def nullif_empty(self, x: str) -> str:
        return f"NULLIF({x}, '')"

    def try_int(self, x: str) -> str:
        return f"TRY_CAST({x} AS INTEGER)"

    def try_bigint(self, x: str) -> str:
        return f"TRY_CAST({x} AS BIGINT)"

    found_int, found_bigint = try_int, try_bigint

    def try_double(self, x: str) -> str:
        return f"TRY_CAST({x} AS DOUBLE)"

    def between(self, x: str, lo, hi) -> str:
        return f"({x} >= {lo} AND {x} <= {hi})"

    def and_(self, *cs: str) -> str:
        return "(" + " AND ".join(cs) + ")"

    def or_(self, *cs: str) -> str:
        return "(" + " OR ".join(cs) + ")"

    def not_(self, c: str) -> str:
        return f"(NOT {c})"

    def eq(self, x: str, y) -> str:
        return f"({x} = {self.lit(y)})"

    def lt(self, x: str, y: str) -> str:
        return f"({x} < {y})"

    def lower(self, x: str) -> str:
        return f"lower({x})"

    def concat(self, *xs: str) -> str:
        return "(" + " || ".join(xs) + ")"

    def replace(self, x: str, search: str, repl: str) -> str:
        return f"replace({x}, {sql_str(search)}, {sql_str(repl)})"

    def ceil_int(self, x: str) -> str:
        return f"CAST(ceil({x}) AS INTEGER)"

    def mul(self, x: str, k: int) -> str:
        return f"({x} * {k})"

    def mul_col(self, x: str, y: str) -> str:
        return f"({x} * {y})"

    def date_iso(self, x: str, fmt: str) -> str:
        duck_fmt = {"month_full": "%B %d %Y", "month_abbr": "%b %d %Y", "ymd": "%Y-%m-%d"}[fmt]
        return f"strftime(try_strptime({x}, {sql_str(duck_fmt)}), '%Y-%m-%d')"

    def contains(self, x: str, s: str) -> str:
        return f"contains({x}, {sql_str(s)})"

    def strip(self, x: str) -> str:
        return self.regexp_replace(x, STRIP_PATTERN, "")

    def one_space(self, x: str) -> str:
        return self.regexp_replace(x, SPACES_PATTERN, " ")

    def contains_any(self, x: str, literals) -> str | None:
        return None  # the oracle runs every regex as written

    def word_view(self, x: str) -> str:
        """RE2's \\b is ASCII-only.  Rules are ASCII, so mapping every
        non-ASCII letter or digit to 'x' gives the word boundaries Python
        sees without changing any match of an ASCII literal."""
        return f"regexp_replace({x}, '[^\\x00-\\x7f\\PL]|[^\\x00-\\x7f\\PN]', 'x', 'g')"

    # -- fixture and plumbing helpers --
    def pick(self, key: str, values: list[str]) -> str:
        items = ", ".join(sql_str(v) for v in values)
        return f"([{items}][({key} % {len(values)}) + 1])"

    def mod(self, x: str, k: int) -> str:
        return f"({x} % {k})"

    def idiv(self, x: str, k: int) -> str:
        return f"CAST(floor({x} / {k}) AS BIGINT)"

    def to_str(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def lpad(self, x: str, n: int, pad: str) -> str:
        return f"lpad({x}, {n}, {sql_str(pad)})"

    def concat_ws(self, sep: str, *xs: str) -> str:
        return f"concat_ws({sql_str(sep)}, {', '.join(xs)})"

    def sha_id(self, prefix: str, *xs: str) -> str:
        return f"({sql_str(prefix)} || sha256(concat_ws(chr(1), {', '.join(xs)})))"

    def add(self, x: str, y: str) -> str:
        return f"({x} + {y})"

    def neg(self, x: str) -> str:
        return f"(-{x})"

    _var = 0

    def _lambda(self, fn):
        DuckDialect._var += 1
        v = f"v{DuckDialect._var}"
        return v, fn(v)

    def filter_arr(self, arr: str, fn) -> str:
        v, body = self._lambda(fn)
        return f"list_filter({arr}, lambda {v}: {body})"

    def exists_arr(self, arr: str, fn) -> str:
        v, body = self._lambda(fn)
        return f"(len(list_filter({arr}, lambda {v}: {body})) > 0)"

    def transform_arr(self, arr: str, fn) -> str:
        v, body = self._lambda(fn)
        return f"list_transform({arr}, lambda {v}: {body})"

    def last_elem(self, arr: str) -> str:
        return f"({arr})[-1]"

    def first_elem(self, arr: str) -> str:
        return f"({arr})[1]"

    def array_join(self, arr: str, sep: str) -> str:
        return f"array_to_string({arr}, {sql_str(sep)})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def slice_arr(self, arr: str, start: int, n: int) -> str:
        return f"({arr})[{start}:{start + n - 1}]"

    def to_int(self, x: str) -> str:
        return f"CAST({x} AS INTEGER)"

    def le(self, x: str, y) -> str:
        return f"({x} <= {self.lit(y)})"

    def split(self, x: str, sep: str) -> str:
        return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({x}, {sql_str(sep)}) END"

    def ge(self, x: str, y) -> str:
        return f"({x} >= {self.lit(y)})"

    def ne(self, x: str, y) -> str:
        return f"({x} <> {self.lit(y)})"

    def isin(self, x: str, values) -> str:
        return f"({x} IN ({', '.join(self.lit(v) for v in values)}))"

    def is_null(self, x: str) -> str:
        return f"({x} IS NULL)"

    def startswith(self, x: str, s: str) -> str:
        return f"starts_with({x}, {sql_str(s)})"

    def btrim(self, x: str, chars: str) -> str:
        return f"trim({x}, {sql_str(chars)})"

    def length(self, x: str) -> str:
        return f"length({x})"

    def substr(self, x: str, start: int, n: int) -> str:
        return f"substr({x}, {start}, {n})"

    def try_iso_timestamp(self, x: str) -> str:
        return (f"CASE WHEN regexp_matches({x}, {sql_str(ISO_PATTERN)}) THEN TRY_CAST({x} AS TIMESTAMP) "
                f"WHEN regexp_matches({x}, {sql_str(ISO_BASIC_PATTERN)}) THEN try_strptime({x}, '%Y%m%d') "
                f"WHEN regexp_matches({x}, {sql_str(ISO_COMPACT_PATTERN)}) THEN try_strptime(rpad({x}, 15, '0'), '%Y%m%dT%H%M%S') END")

    def part(self, ts: str, unit: str) -> str:
        return f"CAST(date_part('{unit}', {ts}) AS INTEGER)"

    def weekday(self, ts: str) -> str:
        return f"CAST(isodow({ts}) - 1 AS INTEGER)"

    def try_named_date(self, x: str) -> str:
        forms = [f"CASE WHEN regexp_matches({x}, {sql_str(pattern)}) THEN try_strptime({x}, {sql_str(c)}) END"
                 for pattern, _, c in DATE_FORMS]
        return f"coalesce({', '.join(forms)})"

    def minus_seconds(self, ts: str, secs: str) -> str:
        return f"make_timestamp(epoch_us({ts}) - {secs} * 1000000)"

    def day_start(self, ts: str, days_back: int = 0) -> str:
        base = f"date_trunc('day', {ts})"
        return f"CAST({base} - INTERVAL {days_back} DAY AS TIMESTAMP)" if days_back else f"CAST({base} AS TIMESTAMP)"

    def ts_lit(self, iso: str) -> str:
        return f"TIMESTAMP {sql_str(iso)}"

    def plus_hours(self, ts: str, hours: str) -> str:
        return f"make_timestamp(epoch_us({ts}) + {hours} * 3600000000)"


SPARK = SparkDialect()
DUCK = DuckDialect()
