"""URL filters by pattern rules under an index of literal tokens.

A rule is a pattern over the address (what follows ``://``, host lower-cased):

* ``||`` at the start: the start of the host or of one of its parent domains;
* ``|`` at the start or end: the start or end of the address;
* ``*``: anything; ``^``: a separator (not a letter, digit or one of
  ``_ - . %``) or the end; all else stands for itself, case included.

Each rule is filed under the rarest of its literal tokens (runs of a-z and 0-9
that any address it fits holds as a whole token; how rare is counted over the
addresses).  An address fetches the rules under its own tokens, and only those
run their regular expression.  Rules without such a token are filed under the
empty one, which every address has.

All work is Spark's own functions; an address is shuffled once, with its key
columns, behind a map-side aggregate of what its tokens fetched.  The index is
sent to every executor if it was counted to be small, else joined by hash.

Null addresses and those without ``://`` have an empty host and path and are
judged like any other.  Equal rows are judged one by one, null keys too; a very
long address costs one row per distinct token.  Of the rules that fit, the one
of the highest rank wins, then the longer pattern, then the pattern that sorts
last, so ties do not depend on the order of rows.  Without rules every verdict
is the default; an empty table gives an empty result.  Only the key columns are
taken over, so other columns of the table may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentgrid.llm.tables import ascii_lower, sized, written

TOKEN = "[a-z0-9]+"
RULE_COLUMNS = "struct<pattern:string,verdict:string,rank:int>"


def rules(spark: SparkSession, listed: Iterable[tuple[str, str, int]]) -> DataFrame:
    """``pattern, verdict, rank`` rows of a list of rules."""
    rows = [F.struct(F.lit(p).alias("pattern"), F.lit(v).alias("verdict"), F.lit(r).alias("rank")) for p, v, r in listed]
    table = F.array(*rows).cast(f"array<{RULE_COLUMNS}>")
    return spark.range(1).select(F.inline(table))


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null or without it: empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    """Up to the first ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(rest: Column) -> Column:
    """Behind the host, up to the first ``?`` or ``#``."""
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def literal_tokens(pattern: Column) -> Column:
    """Tokens that stand between characters which no token can hold (a ``*``
    or an open end could lengthen them, so such runs do not count)."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(pattern), F.lit(rf"(?<=[^a-z0-9*]){TOKEN}(?=[^a-z0-9*])"), F.lit(0)))


def as_regex(pattern: Column) -> Column:
    """The regular expression of a pattern."""
    host, start, end = pattern.startswith("||"), pattern.startswith("|"), pattern.endswith("|") & (F.length(pattern) > 2)
    head = F.when(host, F.lit(r"^(?:[^/?#]*\.)?")).when(start, F.lit("^")).otherwise(F.lit(""))
    skip = F.when(host, 2).when(start, 1).otherwise(0)
    body = F.substring(pattern, skip + 1, F.length(pattern) - skip - end.cast("int"))
    body = F.regexp_replace(body, r"[.+?$|{}()\[\]\\]", r"\\$0")
    body = F.regexp_replace(body, r"\^", r"(?:[^a-zA-Z0-9_.%-]|\\z)")
    body = F.regexp_replace(body, r"\*", ".*")
    return F.concat(F.lit("(?s)"), head, body, F.when(end, F.lit(r"\z")).otherwise(F.lit("")))


def _index(addresses: DataFrame, listed: DataFrame) -> DataFrame:
    """``token, number, pattern, verdict, rank, regex``: each rule once, under
    its rarest token.  A higher number wins."""
    listed = listed.where(F.col("pattern").isNotNull()).select("pattern", "verdict", "rank").distinct()
    order = Window.orderBy("rank", F.length("pattern"), "pattern", "verdict")
    listed = listed.withColumn("number", F.row_number().over(order))
    tokens = written(listed.select("number", F.explode(literal_tokens(F.col("pattern"))).alias("token")), "url-tokens")
    seen = addresses.select(F.explode("tokens").alias("token"))
    seen = seen.join(sized(tokens.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = tokens.join(seen, "token", "left").groupBy("number").agg(
        F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    return listed.join(rarest, "number", "left").select(
        F.coalesce("token", F.lit("")).alias("token"), "number", "pattern", "verdict", "rank",
        as_regex(F.col("pattern")).alias("regex"))


def judge(table: DataFrame, listed: DataFrame, keys: Sequence[str] = ("page_id",), url: str = "url",
          default: str = "allow") -> DataFrame:
    """``keys, host, path, pattern, rank, verdict`` of every row of a table:
    the deciding rule and what it says (none: null and ``default``)."""
    rest = rest_of(F.col(url))
    addresses = table.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], host_of(rest).alias("host"), path_of(rest).alias("path"),
        F.concat(host_of(rest), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)", 1)).alias("address"))
    addresses = addresses.withColumn("tokens", F.array_distinct(F.concat(
        F.array(F.lit("")), F.regexp_extract_all(ascii_lower(F.col("address")), F.lit(TOKEN), F.lit(0)))))
    index = written(_index(addresses, listed), "url-rules")
    names = [f"k{i}" for i in range(len(keys))]
    fetched = addresses.withColumn("row", F.monotonically_increasing_id()).select(
        "row", *names, "host", "path", "address", F.explode("tokens").alias("token"))
    fetched = fetched.join(sized(index.select("token", "number", "regex")), "token", "left")
    fits = F.when(F.rlike("address", F.col("regex")), F.col("number"))
    best = fetched.groupBy("row", *names, "host", "path").agg(F.max(fits).alias("number"))
    out = best.join(sized(index.select("number", "pattern", "rank", "verdict")), "number", "left")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "host", "path", "pattern", "rank",
                      F.coalesce("verdict", F.lit(default)).alias("verdict"))
