"""Removal of repeated byte strings by hash-compared suffix sorting (operator 7).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else.  Sorting every suffix of the corpus would move many times its size, so
suffixes are sorted where repeats can be:

1. Each window of ``LENGTH`` bytes has an anchor, its least ``SEED_LENGTH``-byte
   string by hash.  Equal windows have equal anchors at equal offsets, so the
   windows of an anchor form a piece, and pieces are the buckets of the suffix
   order that begin with one string.  Only hashes of anchors and pieces are
   shuffled.
2. A piece whose bytes occur again is repeated as a whole (128 bits of two
   unlike hashes).  An anchor that occurs once has no repeated window.
3. Of the other anchors (the ends of repeats) one piece of each kind is read.
   The suffixes at the anchor, and the reversed texts before it, are sorted by
   a merge sort that compares two suffixes in logarithmic time: prefix
   polynomial hashes and binary search give their common extension.  Neighbours
   are verified on their bytes.  The windows at one offset are equal where both
   extensions reach far enough.

Anchors with more than ``HOT`` different pieces are not sorted in one task:
their windows are counted one by one, with map-side combining.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm import arrowtext as at
from rentgrid.llm.tables import release, small_batches, written

LENGTH = 400
SEED_LENGTH = 200
#: Pieces of one anchor that one task sorts, at most.
HOT = 20_000
#: Bytes of pieces that are sorted together, and of one text read at a time.
CHUNK, SEGMENT = 4 << 20, 2 << 20

_POSITION = 22


def _mark(data: np.ndarray, starts, ends) -> list[int]:
    """A 32-bit mark of each text: tells rows of one key and other texts apart."""
    raw = data.tobytes()
    return [xxhash.xxh32_intdigest(raw[a:b]) >> 1 for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _anchors(data: np.ndarray, starts, ends, length: int, seed: int):
    """``(row, first, last, anchor, anchor hash)`` of each run of windows with
    one anchor; positions in ``data``."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    prefix = at.prefix_hash(data)
    begin = np.arange(n - seed + 1)
    seeds = at.range_hash(prefix, begin, begin + seed)
    low = np.uint64((1 << _POSITION) - 1)
    least = (at.mix(seeds) & ~low) | begin.astype(np.uint64)
    width, span = length - seed + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    anchor = (least & low).astype(np.int64)
    window = np.arange(n - length + 1)
    row = np.searchsorted(starts, window, "right") - 1
    inside = window + length <= ends[row]
    window, row, anchor = window[inside], row[inside], anchor[inside]
    if not len(window):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return row[first], window[first], window[last], anchor[first], seeds[anchor[first]]


def _segments(data, starts, ends, length: int):
    """Long texts in overlapping parts, so that a position has few bits; every
    window is in one part."""
    if len(data) <= SEGMENT * 2:
        yield 0, data, starts, ends, 0
        return
    for r, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for x in range(a, max(a + 1, b - length + 1), SEGMENT):
            part = data[x:min(b, x + SEGMENT + length - 1)]
            yield r, part, np.zeros(1, np.int64), np.full(1, len(part)), x - a


def _pieces(length, seed):
    names = ["doc_id", "mark", "lo", "hi", "anchor", "ah", "ph"]

    def run(batches):
        for b in batches:
            for first, data, starts, ends in at.slices(b.column(1)):
                marks = np.array(_mark(data, starts, ends), np.int64)
                for r0, part, s, e, shift in _segments(data, starts, ends, length):
                    row, lo, hi, anchor, ah = _anchors(part, s, e, length, seed)
                    if not len(row):
                        continue
                    raw = part.tobytes()
                    ph = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y + length], p - x) for x, y, p in zip(
                        lo.tolist(), hi.tolist(), anchor.tolist(), strict=True)), np.uint64, len(lo))
                    base = s[row] - shift
                    ids = b.column(0).take(pa.array(first + r0 + row))
                    yield pa.RecordBatch.from_arrays([
                        ids, pa.array(marks[r0 + row].astype(np.int32)), pa.array(lo - base), pa.array(hi - base),
                        pa.array(anchor - base), pa.array(ah.view(np.int64)), pa.array(ph.view(np.int64))], names)
    return run


class _Suffixes:
    """Suffixes of one buffer, compared by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        self.prefix = at.prefix_hash(data)
        self.down = at._power("down", pow(at._BASE, -1, 1 << 64), len(data) + 1)

    def _same(self, i, j, n):
        a, b = self.start[i], self.start[j]
        return (self.prefix[a + n] - self.prefix[a]) * self.down[a] == (self.prefix[b + n] - self.prefix[b]) * self.down[b]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of suffixes i and j, by binary search on its length."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = self._same(i, j, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j (false if they are equal)."""
        n = self.common(i, j)
        ended = (n == self.length[i]) | (n == self.length[j])
        last = len(self.data) - 1
        x = self.data[np.minimum(self.start[i] + n, last)]
        y = self.data[np.minimum(self.start[j] + n, last)]
        return np.where(ended, self.length[i] < self.length[j], x < y)

    def order(self, group: np.ndarray) -> np.ndarray:
        """Suffix order within each group (runs of one number), by merging
        runs of 1, 2, 4, ...; all merges of a round run at once."""
        n = len(group)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        at_ = np.arange(n)
        out, width = at_.copy(), 1
        while n and width < size.max():
            part = np.flatnonzero(count > width)
            place = at_[part] - begin[part]
            run = place // width
            left = run % 2 == 0
            other = begin[part] + np.where(left, run + 1, run - 1) * width
            end = begin[part] + count[part]
            low = np.minimum(other, end)
            start, high = low.copy(), np.minimum(other + width, end)
            me = out[part]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                x, y = out[mid], me[open_]
                # ties keep the left run first
                less = np.where(left[open_], self.before(x, y), ~self.before(y, x))
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            to = begin[part] + (run // 2) * 2 * width + place % width + (low - start)
            merged = out.copy()
            merged[to] = me
            out, width = merged, width * 2
        return out

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension with the suffix before in order (-1 at a group's
        first), verified on the bytes."""
        out = np.full(len(order), -1, np.int64)
        same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1 if len(order) else np.zeros(0, np.int64)
        out[same] = self.common(order[same - 1], order[same])
        for k in same.tolist():
            a, b, n = self.start[order[k - 1]], self.start[order[k]], out[k]
            x, y = self.data[a:a + n], self.data[b:b + n]
            if not np.array_equal(x, y):  # a collision: the bytes decide
                out[k] = int(np.flatnonzero(x != y)[0])
        return out


def repeated_offsets(pieces: list[bytes], anchor: np.ndarray, group: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Which windows of each piece are equal to one of another piece of its
    group: a table of (piece, distance of the anchor from the window's start)."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    right = _Suffixes(data, begin + anchor, sizes - anchor)
    back = data[::-1].copy()
    left = _Suffixes(back, len(data) - begin - anchor, anchor)
    n = len(pieces)
    runs = []
    for side in (right, left):
        order = side.order(group)
        runs.append((order, side.neighbours(order, group)))
    (right_order, right_common), (left_order, left_common) = runs
    out = np.zeros((n, length - seed + 1), bool)
    most, fewest = anchor, anchor - (sizes - length)  # the windows of a piece, by distance
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for distance in range(length - seed + 1):
        own = np.flatnonzero((fewest <= distance) & (distance <= most))
        if len(own) < 2:
            continue
        of_right[right_order] = np.cumsum(right_common < length - distance)
        of_left[left_order] = np.cumsum(left_common < distance)
        key = of_right[own] * (n + 1) + of_left[own]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        out[own, distance] = count[inverse] > 1
    return out


def _sort_pieces(length, seed):
    names = ["doc_id", "mark", "lo", "hi"]

    def solved(rows):
        ah, anchor, piece, ids, marks, lo, copies = zip(*rows, strict=True)
        anchor = np.array(anchor, np.int64)
        group = np.unique(np.array(ah, np.int64), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        table = repeated_offsets([piece[i] for i in order], anchor[order], group[order], length, seed)
        out = [[], [], [], []]
        for k, i in enumerate(order.tolist()):
            if copies[i] > 1 or not table[k].any():
                continue  # pieces with copies are repeated as a whole
            d = np.flatnonzero(np.diff(np.concatenate([[0], table[k].astype(np.int8), [0]])))
            for a, b in zip(d[::2].tolist(), d[1::2].tolist(), strict=True):
                place = lo[i] + int(anchor[i])
                for x, v in zip(out, (ids[i], marks[i], place - b + 1, place - a + length), strict=True):
                    x.append(v)
        return out

    def run(batches):
        rows, size, kind = [], 0, None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for row in zip(*(b.column(c).to_pylist() for c in ("ah", "anchor", "piece", "doc_id", "mark", "lo", "copies")),
                           strict=True):
                if size >= CHUNK and row[0] != rows[-1][0]:
                    yield _batch(solved(rows), names, kind)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield _batch(solved(rows), names, kind)
    return run


def _batch(columns, names, kind):
    ids, marks, lo, hi = columns
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(marks, pa.int32()), pa.array(lo, pa.int64()),
                                       pa.array(hi, pa.int64())], names)


def packed(batches):
    """Texts as compressed bytes, to be moved; with their marks."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        for first, data, starts, ends in at.slices(b.column(1)):
            raw = data.tobytes()
            texts = [pack(raw[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)),
                                              pa.array(_mark(data, starts, ends), pa.int32()),
                                              pa.array(texts, pa.binary())], ["doc_id", "mark", "packed"])


def _cut_pieces(length):
    names = ["doc_id", "mark", "lo", "anchor", "ah", "copies", "hot", "piece"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(b.num_rows):
                text = unpack(b.column(2)[i].as_py())
                wanted = b.column(3)[i].as_py()
                k = len(wanted)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column(0)[i].as_py()] * k, b.schema.field(0).type),
                    pa.array([b.column(1)[i].as_py()] * k, pa.int32()), pa.array([w["lo"] for w in wanted], pa.int64()),
                    pa.array([w["anchor"] - w["lo"] for w in wanted], pa.int64()),
                    pa.array([w["ah"] for w in wanted], pa.int64()), pa.array([w["copies"] for w in wanted], pa.int64()),
                    pa.array([w["hot"] for w in wanted], pa.bool_()),
                    pa.array([text[w["lo"]:w["hi"] + length] for w in wanted], pa.binary())], names)
    return run


def _windows(length):
    def run(batches):
        for b in batches:
            for doc, mark, lo, copies, piece in zip(*(b.column(c).to_pylist() for c in (
                    "doc_id", "mark", "lo", "copies", "piece")), strict=True):
                k = len(piece) - length + 1
                digest = [hashlib.blake2b(piece[s:s + length], digest_size=16).digest() for s in range(k)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * k, b.schema.field("doc_id").type), pa.array([mark] * k, pa.int32()),
                    pa.array(range(lo, lo + k), pa.int64()), pa.array([copies] * k, pa.int64()),
                    pa.array(digest, pa.binary())], ["doc_id", "mark", "lo", "copies", "digest"])
    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED_LENGTH,
            hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The texts, packed, and the repeated stretches ``doc_id, mark, lo, hi``
    (which may overlap), by (key, mark)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    pieces = written(rows.mapInArrow(_pieces(length, seed), (
        f"doc_id {kind}, mark int, lo long, hi long, anchor long, ah long, ph long")), "suffix-pieces")
    classes = pieces.groupBy("ah", "ph").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    anchors = classes.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("_all")).where("_all > 1")
    known = written(classes.join(anchors, "ah").select("ah", "ph", "copies", "first", "kinds"), "suffix-classes")
    found = written(pieces.join(known, ["ah", "ph"]), "suffix-found")
    many_kinds = not known.where(F.col("kinds") > hot).isEmpty()
    release(pieces, known)
    sure = found.where("copies > 1").select("doc_id", "mark", "lo", (F.col("hi") + length).alias("hi"))
    # one piece of each kind, where an anchor has several kinds; a piece with
    # copies may come from any of them
    ends = found.where(F.col("kinds") > 1).where(F.col("doc_id").eqNullSafe(F.col("first")))
    ends = ends.withColumn("_one", F.when(F.col("copies") > 1, F.struct("ah", "ph", F.lit(0).alias("lo"))).otherwise(
        F.struct("ah", "ph", F.col("lo").cast("int").alias("lo")))).dropDuplicates(["_one"])
    wanted = ends.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(
        "lo", "hi", "anchor", "ah", "copies", (F.col("kinds") > hot).alias("hot"))).alias("wanted"))
    texts = rows.mapInArrow(packed, f"doc_id {kind}, mark int, packed binary")
    cut = texts.join(wanted.hint("shuffle_hash"), ["doc_id", "mark"]).select("doc_id", "mark", "packed", "wanted").mapInArrow(
        _cut_pieces(length), (f"doc_id {kind}, mark int, lo long, anchor long, ah long, copies long, hot boolean, "
                              "piece binary"))
    stretch = f"doc_id {kind}, mark int, lo long, hi long"
    if not many_kinds:
        ended = cut.repartition("ah").sortWithinPartitions("ah").mapInArrow(_sort_pieces(length, seed), stretch)
    else:
        cut = written(cut, "suffix-ends")
        ended = cut.where("NOT hot").repartition("ah").sortWithinPartitions("ah").mapInArrow(
            _sort_pieces(length, seed), stretch)
        windows = written(cut.where("hot").mapInArrow(_windows(length), (
            f"doc_id {kind}, mark int, lo long, copies long, digest binary")), "suffix-windows")
        again = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest")
        ended = ended.unionByName(windows.where("copies = 1").join(again, "digest").select(
            "doc_id", "mark", "lo", (F.col("lo") + length).alias("hi")))
    return texts, sure.unionByName(ended)


def _kept(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        out = [[], [], [], []]
        for packed, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = unpack(packed)
            kept, at_, removed, runs = [], 0, 0, 0
            for s in sorted(spans or (), key=lambda s: (s["lo"], s["hi"])):
                if s["hi"] <= at_ and runs:
                    continue
                if s["lo"] > at_ or not runs:
                    kept.append(text[at_:s["lo"]])
                    runs += 1
                    removed += s["hi"] - s["lo"]
                else:
                    removed += s["hi"] - at_
                at_ = s["hi"]
            kept.append(text[at_:])
            for x, v in zip(out, (len(text), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]),
                                          pa.array(out[3], pa.string())], names)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                    seed: int = SEED_LENGTH, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    A null text counts as empty; texts under the length lose nothing; repeated
    rows are repeats of each other; rows of one key with other texts are told
    apart; an empty table gives no rows; other columns are never read.
    """
    texts, found = repeats(docs, key, text, length, seed, hot)
    spans = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()
    joined = texts.alias("t").join(spans.alias("s").hint("shuffle_hash"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id"))
                                   & (F.col("t.mark") == F.col("s.mark")), "left")
    return joined.select("t.doc_id", "packed", "spans").mapInArrow(
        _kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
