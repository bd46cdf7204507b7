"""N-gram Jaccard join by parity sketches (operator 10).

A document is the set of its distinct word shingles.  Sets whose Jaccard
similarity is at least t differ in at most ``(n1 + n2) * (1 - t) / (1 + t)``
shingles.  Shingles are XOR-hashed into sketches:

* Per size band a set is dealt by hash into pieces, and the hashes of a piece
  are XORed.  One differing shingle changes one piece, so sets that differ in
  d shingles agree in all pieces but d.  A set therefore sends its first
  ``d + 1`` non-empty pieces in one global order (pieces made only of very
  frequent shingles last); a pair that must be found shares one of them.  It
  sends some spare ones more.  As such a pair shares as many more, each set can
  then leave out as many of those that turned out most frequent, and pairs that
  share too few of the rest are dropped by their number.  A set with too few
  non-empty pieces for that sends its empty ones as well and leaves out none, so
  two such sets meet there.
* A bit sketch per band holds the parity of the shingles at each bit.  Its
  Hamming distance never exceeds the symmetric difference, so pairs above the
  bound are dropped before their shingles are read.

What is left is verified on the shingles.  Equal sets are one class from the
start.  Within a group of sets that share a piece, those that often share one
with its most central set are compared with that first, then those of other
components with the next one, for some rounds; only groups that are still in
several components after that are compared further, across components: small
ones pair by pair, large ones by their members' differences from the central set.
Sets x and y that differ from it in ``dx`` and ``dy`` shingles differ from each
other in ``dx + dy`` less twice what both differences hold.  If they may differ in
``m``, both differences hold ``(dx + dy - m) / 2`` shingles at least, and so share
one among the first ``(dx - dy + m) / 2 + 1`` and ``(dy - dx + m) / 2 + 1`` of them
in any one order.  (If that is none, both are linked with the central set.)
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm import arrowtext as at
from rentgrid.llm.components import components
from rentgrid.llm.tables import release, sized, small_batches, written

WORDS = 5
#: Similarity as a fraction in hundredths.
PERCENT = 75
#: Each size band ends at this many times its start.
BAND = 4
#: Pieces for each shingle of the largest set of a band.
PIECES = 2
#: Pieces that a set sends beyond those it must: this part of its shingles.
SPARE = 6
#: Added to the band of a set that sends its empty pieces as well.
_SPARSE = 64
#: A shingle in this share of the documents is very frequent (the order of
#: pieces follows it, not the result) and at most so many are listed.
FREQUENT, MAX_FREQUENT = 0.002, 200_000
#: Pieces per task of the join (about 12 bytes each).
PIECES_PER_BUCKET = 750_000
_SIZE_BITS = 10
#: Rounds of comparing with one class of each group before all that is left is
#: compared (fewer or more change the work, not the result).
ROUNDS = 1
#: Groups of up to so many sets are compared pair by pair, larger ones by the
#: differences from their central set (more or fewer change the work, not the result).
BY_PAIRS = 32


def largest_difference(n1, n2, percent: int = PERCENT):
    """Most shingles that two sets of these sizes can differ in, if linked."""
    return (n1 + n2) * (100 - percent) // (100 + percent)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _bands(n: np.ndarray):
    """The band of each size, and the end of the band."""
    band = np.zeros(len(n), np.int64)
    edge = 1
    while len(n) and edge * BAND <= n.max():
        edge *= BAND
        band += n >= edge
    return band


def _ends(band):
    return BAND ** (band + 1) - 1


def _sets(batch, words):
    """``(first row, rows, distinct shingles by row, owner, size)`` per slice."""
    for first, data, starts, ends in at.slices(batch.column(1)):
        data = at.lower(data)
        begin, end, row = at.words(data, starts)
        hashes = at.range_hash(at.prefix_hash(data), begin, end)
        shingle, owner = at.distinct(*at.shingles(hashes, row, len(starts), words))
        yield first, len(starts), shingle, owner, np.bincount(owner, minlength=len(starts)).astype(np.int64)


def _identity(shingle, n):
    """Two 64-bit hashes of each set; the low bits of the first hold its size
    on a logarithmic scale."""
    one = at.mix(at.per_row(np.add, at.mix(shingle ^ np.uint64(0xA5A5A5A5)), n, np.uint64(0)) + n.astype(np.uint64))
    two = at.mix(at.per_row(np.add, at.mix(shingle + np.uint64(0x1234567)), n, np.uint64(0)))
    scale = np.minimum(np.log(np.maximum(n, 1)) * 48, (1 << _SIZE_BITS) - 1).astype(np.uint64)
    return (one >> np.uint64(_SIZE_BITS) << np.uint64(_SIZE_BITS)) | scale, two


def _bit_sketch(shingle, owner, rows, bits_of_row):
    """Parity of each row's shingles at ``bits_of_row`` bits, as bytes."""
    offset = np.zeros(len(bits_of_row) + 1, np.int64)
    np.cumsum(bits_of_row, out=offset[1:])
    bit = (at.mix(shingle ^ np.uint64(0x51ED270B)) % bits_of_row[owner].astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(offset[owner] + bit, minlength=offset[-1]) & 1).astype(np.uint8)
    packed = np.packbits(parity)
    return [packed[offset[r] >> 3:offset[r + 1] >> 3].tobytes() if bits_of_row[r] else None for r in rows]


def _joins(n, percent):
    """The bands that each set takes part in: its own, and the next one if it
    can have a partner there."""
    band = _bands(n)
    here = n > 0
    above = here & (n * 100 >= percent * (_ends(band) + 1))
    return (band, here), (band + 1, above)


def _most(n, band, percent):
    """Most shingles that a set differs in from any partner in the band."""
    partner = np.minimum(n * 100 // percent, _ends(band))
    return largest_difference(n, np.maximum(partner, n * 0 + 1), percent)


def _profiles(words, percent):
    def run(batches):
        for b in batches:
            for first, rows, shingle, owner, n in _sets(b, words):
                one, two = _identity(shingle, n)
                sketches = []
                for band, on in _joins(n, percent):
                    bits = np.where(on, np.maximum(64, 2 * (_ends(band) + 1)), 0)
                    rows_of = np.arange(rows)
                    used = on[owner]
                    sketches.append(_bit_sketch(shingle[used], owner[used], rows_of, bits))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, rows), pa.array(n), _signed(one), _signed(two),
                     pa.array(sketches[0], pa.binary()), pa.array(sketches[1], pa.binary()), pa.nulls(rows, pa.int64())],
                    ["doc_id", "n", "cid", "h2", "own", "above", "seen"])
                # what is frequent in this slice, for the order of pieces
                value, count = np.unique(shingle, return_counts=True)
                often = count >= max(4, FREQUENT * rows)
                k = int(often.sum())
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(k, b.schema.field(0).type), pa.nulls(k, pa.int64()), _signed(value[often]),
                         pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
                         pa.array(count[often].astype(np.int64))],
                        ["doc_id", "n", "cid", "h2", "own", "above", "seen"])
        at.give_back()
    return run


def _pieces(shingle, owner, n, band, on, frequent, percent):
    """The pieces that the sets send in one band, ``(row, hash, is frequent)``,
    and which sets send their empty ones as well."""
    used = on[owner]
    shingle, owner = shingle[used], owner[used]
    if not len(shingle):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(n), bool)
    count = np.maximum(64, (_ends(band) + 1) * PIECES)
    piece = (at.mix(shingle ^ np.uint64(0xC2B2AE35)) % count[owner].astype(np.uint64)).astype(np.int64)
    if len(frequent):
        where = np.minimum(np.searchsorted(frequent, shingle), len(frequent) - 1)
        often = frequent[where] == shingle
    else:
        often = np.zeros(len(shingle), bool)
    order = np.lexsort((piece, owner))
    shingle, owner, piece, often = shingle[order], owner[order], piece[order], often[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])
    at_first = np.flatnonzero(new)
    value = np.bitwise_xor.reduceat(at.mix(shingle), at_first)
    often = np.logical_and.reduceat(often, at_first)
    row, piece = owner[at_first], piece[at_first]
    most = _most(n, band, percent)
    full = np.bincount(row, minlength=len(n))
    sparse = on & (full <= most + n // SPARE)
    for r in np.flatnonzero(sparse):  # few: sets so small that shingles share pieces
        empty = np.setdiff1d(np.arange(count[r]), piece[row == r])
        row = np.concatenate([row, np.full(len(empty), r)])
        piece = np.concatenate([piece, empty])
        value = np.concatenate([value, np.zeros(len(empty), np.uint64)])
        often = np.concatenate([often, np.ones(len(empty), bool)])
    key = at.mix(value + at.mix((piece * 64 + band[row]).astype(np.uint64)))
    order = np.lexsort((key, often, row))
    row, key, often = row[order], key[order], often[order]
    total = np.bincount(row, minlength=len(n))
    place = np.arange(len(row)) - (np.cumsum(total) - total)[row]
    sent = (place <= most[row] + n[row] // SPARE) | sparse[row]
    return row[sent], key[sent], often[sent], sparse


_SENT = ["bucket", "pieces", "gid", "cid", "band"]


def _sender(words, percent, buckets, frequent):
    """Rows of pieces.  Ordinary ones are packed by bucket; those of frequent
    shingles, whose groups may be huge, go as single rows."""
    def flush(held):
        key, cid, band = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (key >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        key, cid, band, bucket = key[order], cid[order], band[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
        have = np.flatnonzero(np.diff(cut))
        packed = [key[cut[i]:cut[i + 1]].astype(np.uint32).tobytes() + cid[cut[i]:cut[i + 1]].tobytes()
                  + band[cut[i]:cut[i + 1]].tobytes() for i in have]
        none, k = pa.nulls(len(have), pa.int64()), len(have)
        return pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(packed, pa.binary()), none, none,
                                           pa.nulls(k, pa.int32())], _SENT)

    def single(gid, cid, band):
        k = len(cid)
        return pa.RecordBatch.from_arrays([
            pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), _signed(gid), _signed(cid),
            pa.array(band.astype(np.int32))], _SENT)

    def run(batches):
        held, size, known = [], 0, set()
        for b in batches:
            for _, rows, shingle, owner, n in _sets(b, words):
                cid, _ = _identity(shingle, n)
                fresh = np.zeros(rows, bool)  # equal sets of a task are sent once
                fresh[np.unique(cid, return_index=True)[1]] = True
                fresh &= np.fromiter((c not in known for c in cid.tolist()), bool, rows)
                if len(known) > 1_000_000:
                    known = set()
                known.update(cid[fresh].tolist())
                for band, on in _joins(n, percent):
                    row, key, often, sparse = _pieces(shingle, owner, n, band, on & fresh, frequent.value, percent)
                    band = (band + _SPARSE * sparse).astype(np.uint8)
                    held.append((key[~often], cid[row[~often]], band[row[~often]]))
                    size += int((~often).sum())
                    if often.any():
                        yield single(key[often], cid[row[often]], band[row[often]])
            if size >= 1 << 19:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)
        del held, known
        at.give_back()
    return run


def _meet(batches):
    """Groups of sets that share a piece: ``gid, cid, band`` rows.  One bucket
    at a time; a task's buckets come sorted."""
    def groups(bucket, blobs):
        parts = [[], [], []]
        for x in blobs:
            n = len(x) // 13
            parts[0].append(np.frombuffer(x, np.uint32, n))
            parts[1].append(np.frombuffer(x, np.uint64, n, 4 * n))
            parts[2].append(np.frombuffer(x, np.uint8, n, 12 * n))
        key, cid, band = (np.concatenate(p) for p in parts)
        order = np.lexsort((cid, key))
        key, cid, band = key[order], cid[order], band[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
        key, cid, band = key[new], cid[new], band[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.cumsum(first) - 1
        many = (np.bincount(group) > 1)[group]
        gid = at.mix(key[many].astype(np.uint64) + (np.uint64(bucket) << np.uint64(32)))
        return pa.RecordBatch.from_arrays([_signed(gid), _signed(cid[many]), pa.array(band[many].astype(np.int32))], _SENT[2:])

    now, blobs = None, []
    for b in batches:
        for bucket, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != now and blobs:
                yield groups(now, blobs)
                blobs = []
            now = bucket
            blobs.append(x.as_buffer().to_pybytes())
    if blobs:
        yield groups(now, blobs)
    del blobs
    at.give_back()


def _near(percent):
    """Keeps the pairs whose bit sketches differ in no more bits than the sets
    may differ in shingles."""
    def run(batches):
        for b in batches:
            n1, n2 = (b.column(i).to_numpy() for i in (2, 3))
            most = largest_difference(n1, n2, percent)
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                ok[i] = np.bitwise_count(x ^ y).sum() <= most[i]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))],
                                             ["a", "b"])
    return run


def _shingle_sets(words):
    def run(batches):
        for b in batches:
            for first, rows, shingle, owner, n in _sets(b, words):
                offset = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offset), _signed(shingle))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), sets], ["cls", "shingles"])
        at.give_back()
    return run


_DIFFERENCES = "root {0}, n long, d long, tied boolean, place long, shingle long"


def _differences(percent, frequent):
    """Of rows ``lead, cls, root, shingles, lead_shingles``: whether the two sets
    are linked (``tied``), and the first shingles of their difference: those
    that the lead lacks, but for very frequent ones, come first."""
    names = ["lead", "cls", "root", "n", "d", "tied", "place", "shingle"]

    def first(own, lead):
        differ = np.setxor1d(own, lead, assume_unique=True)
        n, m, d = len(own), len(lead), len(differ)
        tied = d * (100 + percent) <= (n + m) * (100 - percent)
        partner = n * 100 // percent
        least = max(0, d - largest_difference(n, partner, percent))  # what a partner differs in from the lead
        if tied:  # the partner is not
            least = max(least, largest_difference(-(-n * percent // 100), m, percent) + 1)
        known = np.isin(differ, lead, assume_unique=True)
        often = np.isin(differ, frequent.value, assume_unique=True)
        differ = differ[np.lexsort((differ, often, known))]
        return n, d, tied, differ[:max(0, (d - least + largest_difference(n, partner, percent)) // 2 + 1)]

    def run(batches):
        for b in batches:
            own, lead = b.column(3), b.column(4)
            found = [first(*(np.sort(x[i].values.to_numpy().view(np.uint64)) for x in (own, lead))) for i in range(b.num_rows)]
            sent = np.array([max(1, len(x[3])) for x in found], np.int64)
            row = np.repeat(np.arange(len(found)), sent)
            # a set that sends nothing still says whether it is tied
            shingle = np.concatenate([x[3] if len(x[3]) else np.zeros(1, np.uint64) for x in found]) if found else \
                np.zeros(0, np.uint64)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sent) - sent, sent)
            place[np.array([not len(x[3]) for x in found], bool)[row]] = -1
            n, d, tied = (np.array([x[k] for x in found], kind)[row] for k, kind in ((0, np.int64), (1, np.int64), (2, bool)))
            yield pa.RecordBatch.from_arrays([
                *(b.column(k).take(pa.array(row)) for k in range(3)), pa.array(n), pa.array(d), pa.array(tied),
                pa.array(place), _signed(shingle)], names)
    return run


class Links:
    """The state of one join: classes of equal sets, and what links them."""

    def __init__(self, docs: DataFrame, key: str, text: str, words: int, percent: int):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        self.words, self.percent = words, percent
        kind = docs.schema[key].dataType.simpleString()
        rows = written(self.docs.mapInArrow(_profiles(words, percent), (
            f"doc_id {kind}, n long, cid long, h2 long, own binary, above binary, seen long")), "parity-profiles")
        self.profiles = rows.where("seen IS NULL")
        # a class is named by the smallest id that has its set
        self.classes = written(self.profiles.where("n > 0").groupBy("n", "cid", "h2").agg(
            F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("copies"),
            F.min("own").alias("own"), F.min("above").alias("above")), "parity-classes")
        total = self.profiles.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.total = (total[0] or 0, total[1] or 0)
        self.frequent = rows.where("seen IS NOT NULL").groupBy("cid").agg(F.sum("seen").alias("seen")).where(
            F.col("seen") >= FREQUENT * self.total[0]).orderBy(F.desc("seen"), "cid").limit(MAX_FREQUENT).select("cid")

    def groups(self) -> DataFrame:
        """``gid, band, cls, n, keeps``: the classes that share a piece.

        ``keeps`` is how many pieces the class has taken part with after it has
        left out its most frequent ones.
        """
        frequent = np.sort(np.array([r[0] for r in self.frequent.collect()], np.int64).view(np.uint64))
        sent = self.sent = self.spark.sparkContext.broadcast(frequent)
        buckets = max(16, self.total[1] // (2 * PIECES_PER_BUCKET))
        rows = self.docs.mapInArrow(_sender(self.words, self.percent, buckets, sent),
                                    "bucket int, pieces binary, gid long, cid long, band int")
        # single rows keep no order and may come from any task; packed ones meet by bucket
        rows = rows.repartition(buckets, F.coalesce(F.col("bucket").cast("long"), F.xxhash64("gid", "cid")))
        met = rows.sortWithinPartitions("bucket").mapInArrow(_split_rows, "gid long, cid long, band int")
        named = met.join(self.classes.select("cid", "cls", "n"), "cid")
        rows = met_rows = written(named.select("gid", "band", "cls", "n").distinct(), "parity-met")
        sizes = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
        sparse = F.col("band") >= _SPARSE
        spare = F.floor(F.floor(F.col("n") * self.percent / 100) / SPARE)
        seldom = Window.partitionBy("cls", "band").orderBy(F.desc("_m"), F.desc("gid"))
        rows = rows.join(sizes, "gid").withColumn("_often", F.row_number().over(seldom))
        rows = rows.where(sparse | (F.col("_often") > spare))
        end = F.lit(BAND) ** (F.col("band") + 1) - 1
        partner = F.least(F.floor(F.col("n") * 100 / self.percent), end)
        most = F.floor((F.col("n") + partner) * (100 - self.percent) / (100 + self.percent))
        keeps = F.when(sparse, 0).otherwise(most + 1 + F.floor(F.col("n") / SPARE) - spare)
        groups = written(rows.select("gid", (F.col("band") % _SPARSE).alias("band"), "cls", "n",
                                     keeps.cast("long").alias("keeps"), F.when(sparse, 0).otherwise(spare).cast(
                                         "long").alias("spare")), "parity-groups")
        release(met_rows)
        return groups

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (``a``, ``b``, ``band``) of classes that are similar enough."""
        kind = self.classes.schema["cls"].dataType.simpleString()
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "parity-wanted")
        sizes = written(self.classes.select("cls", "n", "own", "above").join(sized(wanted), "cls", "left_semi"),
                        "parity-sketches")
        one, two = sizes.alias("x"), sizes.alias("y")
        both = pairs.join(one, F.col("a") == F.col("x.cls")).join(two, F.col("b") == F.col("y.cls"))

        def sketch(side):  # in the band of the pair
            return F.expr(f"CASE WHEN band = {self._band_sql(side + '.n')} THEN {side}.own ELSE {side}.above END")
        near = both.select("a", "b", F.col("x.n").alias("n1"), F.col("y.n").alias("n2"), sketch("x").alias("s1"),
                           sketch("y").alias("s2")).where("s1 IS NOT NULL AND s2 IS NOT NULL")
        near = written(near.mapInArrow(_near(self.percent), f"a {kind}, b {kind}").distinct(), "parity-near")
        release(wanted, sizes)
        sets = self._sets_of(near, "a", "b")
        checked = near.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s1")), "a").join(
            sets.select(F.col("cls").alias("b"), F.col("shingles").alias("s2")), "b")
        common = F.size(F.array_intersect("s1", "s2"))
        union = F.size("s1") + F.size("s2") - common
        links = written(checked.where(common * 100 >= union * self.percent).select("a", "b").distinct(), "parity-links")
        release(sets, near)
        return links

    def _sets_of(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """``cls, shingles`` of the classes in either column."""
        kind = self.classes.schema["cls"].dataType.simpleString()
        wanted = written(pairs.select(F.explode(F.array(a, b)).alias("doc_id")).distinct(), "parity-wanted")
        texts = self.docs.join(sized(wanted), "doc_id", "left_semi")
        sets = written(texts.select("doc_id", "text").mapInArrow(
            _shingle_sets(self.words), f"cls {kind}, shingles array<long>"), "parity-sets")
        release(wanted)
        return sets

    def differences(self, spokes: DataFrame) -> DataFrame:
        """How the classes (``cls, root``) differ from their leads."""
        kind = self.classes.schema["cls"].dataType.simpleString()
        sets = self._sets_of(spokes, "lead", "cls")
        both = spokes.join(sets, "cls").join(
            sets.select(F.col("cls").alias("lead"), F.col("shingles").alias("lead_shingles")), "lead")
        out = written(both.select("lead", "cls", "root", "shingles", "lead_shingles").mapInArrow(
            _differences(self.percent, self.sent), f"lead {kind}, cls {kind}, " + _DIFFERENCES.format(kind)),
            "parity-differences")
        release(sets)
        return out

    def _apart(self, differences: DataFrame) -> DataFrame:
        """The pairs (``a``, ``b``, ``band``) of other roots that differ from one
        lead alike, as far as linked pairs must."""
        rows = differences.where("place >= 0")
        x, y = rows.alias("x"), rows.alias("y")
        low, high = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        most = F.floor((F.col("x.n") + F.col("y.n")) * (100 - self.percent) / (100 + self.percent))
        more = F.col("x.d") - F.col("y.d")
        pairs = x.join(y, (F.col("x.lead") == F.col("y.lead")) & (F.col("x.shingle") == F.col("y.shingle"))
                       & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
                       & ~(F.col("x.tied") & F.col("y.tied")) & (low * 100 >= high * self.percent)
                       & (F.col("x.place") * 2 <= most + more) & (F.col("y.place") * 2 <= most - more))
        return pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), high.alias("_n")).withColumn(
            "band", F.expr(self._band_sql("_n"))).drop("_n").distinct()

    @staticmethod
    def _band_sql(n: str) -> str:
        steps = " + ".join(f"int({n} >= {BAND ** k})" for k in range(1, 62 // (BAND.bit_length() - 1)))
        return f"({steps})"

    def roots(self) -> DataFrame:
        """``node, root`` over classes."""
        groups = self.groups()
        # the likely links first, against one class of each group and round: what
        # is linked already needs no more comparing
        sizes = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("_m"))
        central = written(groups.join(sizes, "gid").groupBy("cls").agg(F.sum("_m").alias("central")), "parity-central")
        compared, links, leaders = [], [], []
        rows = groups.withColumn("root", F.col("cls"))
        for _ in range(ROUNDS):
            lead = written(self._leaders(rows, central, leaders), "parity-leaders")
            stars = self._stars(rows, lead)
            for earlier in compared:
                stars = stars.join(earlier, ["a", "b", "band"], "left_anti")
            compared.append(written(stars, "parity-stars"))
            leaders.append(lead)
            links.append(self.linked(compared[-1]))
            if len(leaders) > 1:
                release(rows)
            rows = self._open(groups, links)
            if rows.isEmpty():
                break
        open_rows = rows
        large = written(open_rows.groupBy("gid").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > BY_PAIRS).select("gid"),
                        "parity-large")
        spokes = written(open_rows.join(sized(large), "gid").join(leaders[0].select("gid", "lead"), "gid").where(
            "cls <> lead").select("lead", "cls", "root").distinct(), "parity-spokes")
        release(central, *leaders)
        differences = self.differences(spokes)
        links.append(written(differences.where("tied").select(
            F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b")).distinct(), "parity-links"))
        small = open_rows.join(sized(large), "gid", "left_anti")
        x, y = small.alias("x"), small.alias("y")
        # lists that must share some pieces after each has left out its spare ones
        low, high = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        most = F.floor((F.col("x.n") + F.col("y.n")) * (100 - self.percent) / (100 + self.percent))
        sent = F.least(F.col("x.keeps") + F.col("x.spare"), F.col("y.keeps") + F.col("y.spare"))
        fewest = sent - most - F.greatest("x.spare", "y.spare")
        pairs = x.join(y, (F.col("x.gid") == F.col("y.gid")) & (F.col("x.cls") < F.col("y.cls"))
                       & (F.col("x.root") != F.col("y.root")) & (low * 100 >= high * self.percent))
        rest = pairs.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.band").alias("band")).agg(
            F.count(F.lit(1)).alias("_shared"), F.max(fewest).alias("_fewest")).where("_shared >= _fewest")
        # of a pair that shares large groups as well not all is counted here, but it is found there
        rest = rest.select("a", "b", "band").unionByName(self._apart(differences)).distinct()
        for earlier in compared:
            rest = rest.join(earlier, ["a", "b", "band"], "left_anti")
        rest = written(rest, "parity-rest")
        release(open_rows, groups, large, spokes, differences, *compared)
        links.append(self.linked(rest))
        out = components(functools.reduce(DataFrame.unionByName, links))
        release(rest, *links)
        return out

    @staticmethod
    def _leaders(rows: DataFrame, central: DataFrame, earlier: list[DataFrame]) -> DataFrame:
        """``gid, lead, lead_root``: the most central class of each group that
        led in no earlier round.  Central is what shares its pieces with most
        others: the text that many are copies of, if it is there."""
        for led in earlier:
            rows = rows.join(led.select(F.col("lead").alias("cls")).distinct(), "cls", "left_anti")
        order = F.struct((-F.col("central")).alias("c"), F.col("cls").alias("lead"), F.col("root").alias("lead_root"))
        return rows.join(central, "cls").groupBy("gid").agg(F.min(order).alias("_l")).select("gid", "_l.lead", "_l.lead_root")

    @staticmethod
    def _stars(rows: DataFrame, leaders: DataFrame) -> DataFrame:
        """The pairs of each group's leader and its members of other roots that
        share half of what either keeps."""
        near = rows.join(leaders, "gid").where((F.col("cls") != F.col("lead")) & (F.col("root") != F.col("lead_root")))
        out = near.groupBy(F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b"), "band").agg(
            F.count(F.lit(1)).alias("_shared"), F.min("keeps").alias("_keeps"))
        return out.where("_shared * 2 >= _keeps").select("a", "b", "band")

    @staticmethod
    def _open(groups: DataFrame, links: list[DataFrame]) -> DataFrame:
        """The rows of the groups that hold more than one component so far."""
        known = components(functools.reduce(DataFrame.unionByName, links))
        labelled = groups.join(known, groups.cls == known.node, "left").select(
            "gid", "band", "cls", "n", "keeps", "spare", F.coalesce("root", "cls").alias("root"))
        mixed = labelled.groupBy("gid").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
        return written(labelled.join(mixed.select("gid"), "gid"), "parity-open")


def _split_rows(batches):
    """Packed rows to their groups; single rows as they are."""
    packed = []

    def ordered():
        for b in batches:
            single = b.filter(b.column(0).is_null())
            if single.num_rows:
                packed.append(single.select(_SENT[2:]))
            rest = b.filter(b.column(0).is_valid())
            if rest.num_rows:
                yield rest

    for out in _meet(ordered()):
        while packed:
            yield packed.pop()
        yield out
    yield from packed


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    ``component_id`` is the smallest key reachable over links.  Null and empty
    texts, and texts of white space, have no shingles and are alone; texts of
    fewer words than a shingle are one shingle; repeated rows with one key
    share its component; an empty table gives no rows; other columns are never
    read.
    """
    links = Links(docs, key, text, words, percent)
    roots = links.roots()
    named = links.classes.select("n", "cid", "h2", "cls").join(
        roots, F.col("cls") == F.col("node"), "left").select(
        "n", "cid", "h2", F.coalesce("root", "cls").alias("component_id"))
    return links.profiles.select("doc_id", "n", "cid", "h2").join(named, ["n", "cid", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
