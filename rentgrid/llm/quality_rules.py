"""Quality rules with cross-document line frequency (operator 9).

Base counts come from one vectorised pass over each text.  Every line with a
word is normalised (A-Z lower-cased, white space made one space, trimmed) and
hashed; per host the distinct documents of each line are counted, where
documents of equal content count once.  Lines above the limit are removed, and
a document that loses most of its words is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm import arrowtext as at
from rentgrid.llm.tables import small_batches, written

#: Base rules: fewest words, and largest share of repeated words (percent).
MIN_WORDS, MAX_REPEATED = 10, 20
#: A line is frequent if it is in more than this many documents of its host,
#: whatever the host's size.  A host with too few documents for that has its
#: boilerplate as well: there a line in more than this share of them is frequent,
#: if it is in at least so many.
LINE_DOCUMENTS, LINE_SHARE, LEAST_DOCUMENTS = 50, 0.5, 3
#: A document that keeps less than this share of its words is depleted.
MIN_LEFT = 0.3
RUN = 5

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_STEP = 0xD6E8FEB86659FD93


def _run_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run [begin, end) of hashes; equal runs give equal hashes."""
    n = len(values) + 1
    up = np.full(n, _STEP, np.uint64)
    down = np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    prefix = np.zeros(n, np.uint64)
    np.cumsum(values * np.cumprod(up)[:-1], out=prefix[1:])
    return at.mix((prefix[end] - prefix[begin]) * np.cumprod(down)[begin] + at.mix((end - begin).astype(np.uint64)))


def _earlier(values, owner):
    """Whether each value equals an earlier one of its row."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    out = np.zeros(len(values), bool)
    a, b = order[1:], order[:-1]
    out[a] = (values[a] == values[b]) & (owner[a] == owner[b])
    return out


def lines_of(data, starts, ends):
    """Start, end (without the break) and row of every \\n-split line."""
    length = ends - starts
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(starts, breaks, "right") - 1
    begin = np.concatenate([starts, breaks + 1])
    end = np.concatenate([ends, breaks])
    owner = np.concatenate([np.arange(len(starts)), row])
    begin_order = np.lexsort((begin, owner))
    return begin[begin_order], end[np.lexsort((end, owner))], owner[begin_order], length


def _base(words_row, data, starts, ends, begin, end, rows):
    """The five counts of each text, and its lines."""
    n_words = np.bincount(words_row, minlength=rows)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.bincount(words_row, lead[end] - lead[begin], rows).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    n_symbols = symbols[ends] - symbols[starts]
    prefix = at.prefix_hash(data)
    word = at.range_hash(prefix, begin, end)
    # words in 5-word windows that occur again in the text
    full = max(0, len(word) - RUN + 1)
    first = np.arange(full)
    first = first[words_row[first] == words_row[first + RUN - 1]] if full else first
    window = _run_hash(word, first, first + RUN)
    order = np.lexsort((window, words_row[first]))
    same = (window[order][1:] == window[order][:-1]) & (words_row[first][order][1:] == words_row[first][order][:-1])
    again = np.zeros(len(first), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + RUN, -1)
    n_repeat = np.bincount(words_row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    # lines that equal an earlier one
    line_begin, line_end, line_row, _ = lines_of(data, starts, ends)
    w0, w1 = np.searchsorted(begin, line_begin), np.searchsorted(begin, line_end)
    has = w1 > w0
    raw = at.range_hash(prefix, line_begin, line_end)
    dup = np.zeros(len(raw), bool)
    dup[has] = _earlier(raw[has], line_row[has])
    n_dup = np.bincount(line_row[dup], minlength=rows)
    folded = at.lower(data)
    low = at.range_hash(at.prefix_hash(folded), begin, end)
    line = _run_hash(low, w0[has], w1[has])
    content = at.range_hash(prefix, starts, ends)
    return (n_words, word_chars, n_symbols, n_dup, n_repeat), content, line, line_row[has], (w1 - w0)[has]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _profiles(batches):
    names = ["doc_id", "host", *_COUNTS, "content", "lines", "line_words"]
    for b in batches:
        for first, data, starts, ends in at.slices(b.column(2)):
            rows = len(starts)
            begin, end, row = at.words(data, starts)
            counts, content, line, line_row, size = _base(row, data, starts, ends, begin, end, rows)
            offset = np.zeros(rows + 1, np.int32)
            np.cumsum(np.bincount(line_row, minlength=rows), out=offset[1:])
            offset = pa.array(offset)
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(first, rows), b.column(1).slice(first, rows),
                *(pa.array(c.astype(np.int64)) for c in counts), pa.array(content.view(np.int64)),
                pa.ListArray.from_arrays(offset, pa.array(line.view(np.int64))),
                pa.ListArray.from_arrays(offset, pa.array(size.astype(np.int64)))], names)


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Base counts, content hash, and hash and words of every line with a word."""
    small_batches(docs.sparkSession)
    kind, host_kind = (docs.schema[c].dataType.simpleString() for c in (key, host))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    out = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")).mapInArrow(
        _profiles, f"doc_id {kind}, host {host_kind}, {counts}, content long, lines array<long>, line_words array<long>")
    return written(out.withColumn("row", F.monotonically_increasing_id()), "rules-profile")


def frequent_lines(profiles: DataFrame) -> DataFrame:
    """``host, line`` above the limit, by distinct documents of the host."""
    lines = profiles.select("host", "content", F.explode("lines").alias("line")).distinct()
    seen = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(
        F.col("documents") >= min(LEAST_DOCUMENTS, LINE_DOCUMENTS + 1))
    hosts = profiles.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_documents"))
    return seen.alias("s").join(hosts.alias("h"), F.col("s.host").eqNullSafe(F.col("h.host"))).where(
        (F.col("documents") > LINE_DOCUMENTS)
        | (F.col("documents") >= LEAST_DOCUMENTS) & (F.col("documents") > F.col("all_documents") * LINE_SHARE)).select("s.host", "line", "documents")


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts and verdict of every row.

    ``doc_id``, the five counts, ``base_failed``, ``kept``, ``n_lines``,
    ``n_removed`` (lines above the limit) and ``words_left``.  A null text has
    no words and fails the base rules, as an empty one does; rows with a null
    host form one host; repeated rows are judged alike; an empty table gives no
    rows; other columns are never read.
    """
    profiles = profile(docs, key, text, host)
    frequent = written(frequent_lines(profiles), "rules-lines")
    lines = profiles.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    removed = lines.alias("a").join(frequent.alias("f"), F.col("a.host").eqNullSafe(F.col("f.host"))
                                    & (F.col("a.line") == F.col("f.line"))).groupBy("a.row").agg(
        F.count(F.lit(1)).alias("n_removed"), F.sum("words").alias("_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("_words", F.lit(0))
    return profiles.join(removed, "row", "left").select(
        "doc_id", *_COUNTS, failed.alias("base_failed"),
        (~failed & (left >= F.col("n_words") * MIN_LEFT)).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        left.alias("words_left"))
