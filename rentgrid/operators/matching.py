"""Fuzzy duplicates: listings of any source that say nearly the same (K1).

Two listings are duplicates when they are in the same neighbourhood, their
prices differ by at most ``tolerance`` and the words of their texts agree:
``|common| / |all| >= share``.  The join is exact.

* Listings alike in neighbourhood, price and words are one item, so copies
  never meet each other; their number weighs the links.
* Sets that agree differ in few words, ``d`` at most for sets of such sizes.
  Their words are dealt by hash to ``d + 1`` parts, of which one at least is
  the same in both: items meet under (neighbourhood, price step, size band,
  part, words of that part).
* Groups are counted before anything is joined.  Dealing the words of a group
  anew, by another hash, makes ``d + 1`` entries of each and many small groups
  of a hot one.  That is done, ``levels`` times, to groups of more items than
  ``limit`` times those entries.
* Only then are pairs made, checked on size, price and a parity sketch of the
  words (a word that one set lacks changes one bit), and verified on the word
  sets.  Groups are made and joined in ``SLICES`` runs, by their hash, so that
  a fraction of the entries is on disk at a time.

Work grows with the links there are: listings that truly agree with thousands
of different others cost their links.  Listings without a price or without
words are alone; keys must be unique and not null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.operators.graph import Steps, components

#: Runs that the groups are joined in, at most, and words of items from which one more is worth it.
SLICES, WORDS_PER_SLICE = 16, 20_000_000
#: Width of a price step in tolerances: the wider, the fewer items are in two steps.
STEP = 8


def words(text: F.Column) -> F.Column:
    """Distinct words (a-z and 0-9, lower-cased), as 64-bit hashes."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))


def _items(base: DataFrame, steps: Steps | None = None) -> DataFrame:
    """One row per different (area, price, words); its id is the least key."""
    steps = steps or Steps(base.sparkSession)
    return steps.keep(base.groupBy("area", "price", "words").agg(F.min("key").alias("item"), F.count(F.lit(1)).alias("copies")))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit changes every output bit)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bands(largest: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of every band of set sizes, and the parts of its sets.  The
    sets that agree with one are in its band or the next to it; two that agree,
    the smaller in a band, differ in fewer words than it has parts."""
    least = [1]
    while least[-1] <= largest:
        least.append(max(least[-1] + 1, -(-least[-1] * den // num)))
    small = np.array(least[1:], np.int64) - 1
    return np.array(least, np.int64), (small + small * den // num) * (den - num) // (den + num) + 1


def _parted(num: int, den: int, level: int, part: int, parts: int) -> Callable:
    """Entries (``item, own, key, price, n, sketch, band, parts``) of items in a
    group (``place``, and from the second deal on ``band``): one for each part
    of the words in its band and, in the first deal, in the band below if sets
    of that may agree.  Only keys of run ``part`` of ``parts`` are made."""
    def run(batches):
        for b in batches:
            words = b.column("words")
            n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(n):
                continue
            word = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(len(n)), n)
            place = b.column("place").to_numpy(zero_copy_only=False).view(np.uint64)
            sketch = np.bitwise_xor.reduceat(np.uint64(1) << (word >> np.uint64(58)), np.cumsum(n) - n)
            word = _mix(word + np.uint64(level))
            least, count = _bands(int(n.max()), num, den)
            if level:
                bands = [b.column("band").to_numpy(zero_copy_only=False).astype(np.int64)]
            else:
                own = np.searchsorted(least, n, "right") - 1
                bands = [own, np.where((own > 0) & (-(-n * num // den) < least[own]), own - 1, -1)]
            for band in bands:
                cells = np.where(band >= 0, count[band], 0)
                first = np.cumsum(cells) - cells
                inside = (band >= 0)[of]
                at, mixed = of[inside], word[inside]
                cell = first[at] + (mixed % count[band[at]].astype(np.uint64)).astype(np.int64)
                upto = np.append(np.uint64(0), np.cumsum(_mix(mixed)[np.argsort(cell, kind="stable")]))
                ends = np.cumsum(np.bincount(cell, minlength=int(cells.sum())))
                sums = upto[ends] - upto[np.append(0, ends)[:-1]]  # of each part; they wrap, and so do their differences
                row = np.repeat(np.arange(len(n)), cells)
                slot = (band[row] << 40) + np.arange(len(row)) - first[row]
                key = _mix(_mix(place[row] ^ _mix(slot.astype(np.uint64))) ^ sums)
                mine = np.flatnonzero(key % np.uint64(parts) == part) if parts > 1 else np.arange(len(key))
                row, key = row[mine], key[mine]
                yield pa.RecordBatch.from_arrays([
                    b.column("item").take(pa.array(row)), b.column("own").take(pa.array(row)), pa.array(key.view(np.int64)),
                    b.column("price").take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(sketch[row].view(np.int64)),
                    pa.array(band[row].astype(np.int32)), pa.array(cells[row].astype(np.int32))],
                    ["item", "own", "key", "price", "n", "sketch", "band", "parts"])
    return run


def _entries(items: DataFrame, tolerance: int, num: int, den: int, limit: int, levels: int, steps: Steps | None = None,
             part: int = 0, parts: int = 1, columns: tuple = ("item", "own", "key", "price", "n")) -> DataFrame:
    """``columns`` of the groups that each item is in, those of run ``part`` of
    ``parts``.  An item is in its own price step and, not as its own, in the
    next one if that starts within the tolerance.

    Entries carry no words, which are many times their size: those in groups
    that are split get the words of their item again for the next deal."""
    steps = steps or Steps(items.sparkSession)
    width = F.greatest(F.lit(tolerance), F.lit(1)) * STEP
    step, ahead = F.floor(F.col("price") / width), F.floor((F.col("price") + tolerance + 1) / width)
    rows = items.select("item", "area", "words", "price", F.explode(F.filter(F.array(
        F.struct(step.alias("step"), F.lit(True).alias("own")), F.struct((step + 1).alias("step"), F.lit(False).alias("own"))),
        lambda s: s["own"] | (ahead > step))).alias("s"))
    rows = rows.select("item", "words", "price", "s.own", F.xxhash64("area", "s.step").alias("place"))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = (f"item {kinds['item']}, own boolean, key long, price {kinds['price']}, n int, sketch long, band int, parts int")
    longer = steps.keep(rows.mapInArrow(_parted(num, den, 0, part, parts), schema))
    done, kept = [], [longer]
    for level in range(1, levels):
        hot = steps.keep(longer.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("parts").alias("_parts"))
                         .where(F.col("_n") > F.lit(limit) * F.col("_parts")).select("key"))
        kept.append(hot)
        if hot.isEmpty():
            break
        done.append(longer.join(hot, "key", "left_anti"))
        mine = longer.join(hot, "key", "left_semi").groupBy("item").agg(
            F.collect_list(F.struct("price", "own", F.col("key").alias("place"), "band")).alias("mine"))
        rows = mine.join(items.select("item", "words"), "item").select("item", "words", F.explode("mine").alias("e")).select(
            "item", "words", "e.*")
        longer = steps.keep(rows.mapInArrow(_parted(num, den, level, 0, 1), schema))
        kept.append(longer)
    done.append(longer)
    out = done[0].select(*columns)
    for more in done[1:]:
        out = out.unionByName(more.select(*columns))
    out = steps.keep(out)
    steps.drop(*kept)
    return out


def links(items: DataFrame, tolerance: int = 50, num: int = 4, den: int = 5, limit: int = 100, levels: int = 4) -> DataFrame:
    """``a, b``: the pairs of items that are duplicates (a < b)."""
    steps = Steps(items.sparkSession)
    if not den >= num > 0 or 2 * num <= den:
        raise ValueError("the share must be over one half and at most one")
    found = items.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = min(SLICES, 1 + found // WORDS_PER_SLICE)
    met = []
    for part in range(parts):
        entries = _entries(items, tolerance, num, den, limit, levels, steps, part, parts, ("item", "own", "key", "price", "n", "sketch"))
        x, y = entries.where("own").alias("x"), entries.alias("y")
        near = (F.col("x.key") == F.col("y.key")) & (F.abs(F.col("x.price") - F.col("y.price")) <= tolerance)
        sized = (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num)
        # sets that agree differ in at most so many words, and each of those in one bit
        differ = F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num)
        once = F.when(F.col("y.own"), F.col("x.item") < F.col("y.item")).otherwise(F.col("x.item") != F.col("y.item"))
        met.append(steps.keep(x.join(y, near & sized & differ & once).select(
            F.least("x.item", "y.item").alias("a"), F.greatest("x.item", "y.item").alias("b")).distinct()))
        steps.drop(entries)
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    pairs = steps.keep(pairs.distinct())
    steps.drop(*met)
    left = items.select(F.col("item").alias("a"), F.col("area").alias("area_a"), F.col("words").alias("words_a"))
    right = items.select(F.col("item").alias("b"), F.col("area").alias("area_b"), F.col("words").alias("words_b"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    alike = common * den >= num * (F.size("words_a") + F.size("words_b") - common)
    out = steps.keep(pairs.join(left, "a").join(right, "b").where(F.col("area_a").eqNullSafe(F.col("area_b")) & alike).select("a", "b"))
    steps.drop(pairs)
    return out


def _digests() -> list[F.Column]:
    """128 bits of what an item is."""
    return [F.xxhash64("area", "price", "words").alias("d"), F.xxhash64("words", F.lit(0), "price", "area").alias("e")]


def fuzzy_duplicates(df: DataFrame, key: str, text: F.Column, price: str = "price", area: str = "neighbourhood",
                     source: str = "source", **how) -> DataFrame:
    """Every listing with ``class_id`` (least key that its links reach, its
    own without any), ``links`` (listings that it is a duplicate of, copies
    included) and the listings and sources of its class."""
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(price).alias("price"),
                     F.col(area).alias("area"), words(text).alias("words"))
    steps = Steps(df.sparkSession)
    rows = steps.keep(rows)
    base = rows.where(F.col("price").isNotNull() & (F.size("words") > 0))
    items = _items(base, steps)
    pairs = links(items, **how)
    roots = components(pairs)
    copies = items.select("item", "copies")
    ends = pairs.select(F.col("a").alias("item"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("item"), F.col("a").alias("other")))
    many = ends.join(copies.withColumnRenamed("item", "other"), "other").groupBy("item").agg(F.sum("copies").alias("many"))
    known = copies.join(many, "item", "left").join(roots.withColumnRenamed("node", "item"), "item", "left").select(
        "item", F.coalesce("root", "item").alias("class_id"), (F.coalesce("many", F.lit(0)) + F.col("copies") - 1).alias("links"))
    names = items.select("item", *_digests())
    placed = base.select("key", *_digests()).join(names, ["d", "e"]).select("key", "item").join(known, "item")
    out = rows.select("key", "source").join(placed.select("key", "class_id", "links"), "key", "left").select(
        "key", "source", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = steps.keep(out)
    steps.drop(rows, items)
    totals = out.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_listings"), F.countDistinct("source").alias("class_sources"))
    return out.join(totals, "class_id").select(F.col("key").alias(key), "source", "class_id", "links", "class_listings", "class_sources")
