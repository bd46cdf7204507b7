"""Mixing sources to target weights by subset-sum fitting (operator 1).

Sizes are counted once and written as a narrow table.  Sources are reduced to
(source, length) histograms; targets come from water-filling over the sources.
A source's target is whole passes over all its documents plus a remaining
budget below its size.  That budget is first spread in proportion over the
lengths, and the rest is fitted by a bounded-knapsack dynamic program over
length counts.  The chosen count of each length is then filled with documents
in the order of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm.tables import written

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights that the sources take in turn, by code point order, null last.
WEIGHTS = (1, 2, 3)
#: No source and no document is used more often than this.
MAX_REPEATS = 3
SEED = 42
#: Largest budget, in words, that the dynamic program works on.
DP_BUDGET = 1 << 16
#: Hash ranges that a (source, length) group is split into when it is ranked.
RANK_BUCKETS = 1024


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` per source (one row each).

    The sum of all sizes is shared by weight.  No target passes ``cap`` times
    its source's size; what is cut is shared again by weight until none is
    above.  That fixed point is ``min(cap * size, level * weight)`` with one
    level: in the order of ``cap * size / weight`` a prefix is cut and the
    rest shares what is left.  The windows run over the list of sources, not
    over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    cut = F.col("source_size") * F.lit(float(cap))
    by_ratio = Window.orderBy(cut / F.col("_w"), F.col("source").cast("binary").asc_nulls_last())
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_all", F.sum("source_size").over(whole)).withColumn(
        "_level", (F.col("_all") - F.coalesce(F.sum(cut).over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    # the first source in this order that stays under its cut sets the level
    level = F.min(F.when(F.col("_level") * F.col("_w") <= cut, F.struct(
        (cut / F.col("_w")).alias("ratio"), F.col("_level").alias("level")))).over(whole)["level"]
    target = F.least(cut, F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))
    return per.select("source", "source_size", target.alias("target"))


def knapsack(lengths, counts, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes near ``budget``.

    First an equal share of every count, then, from the longest on, whole
    items while they fit, until the rest is small enough for the dynamic
    program; that one finds the nearest sum with what it is given.  If all
    items together are small enough it is given all, and the sum is the
    nearest there is.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    order = np.argsort(-lengths, kind="stable")
    length, left = lengths[order], counts[order].copy()
    total = int((length * left).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    budget = min(int(budget), total)
    share = 0 if total <= DP_BUDGET else budget
    taken = np.array([int(n) * share // total for n in left], np.int64)
    left -= taken
    rest = budget - int((taken * length).sum())
    for i in range(len(length)):
        if rest <= DP_BUDGET:
            break
        if length[i]:
            more = min(int(left[i]), max(0, rest - DP_BUDGET // 2) // int(length[i]))
            taken[i], left[i], rest = taken[i] + more, left[i] - more, rest - more * int(length[i])
    return_order = np.zeros(len(lengths), np.int64)
    return_order[order] = taken + _exact(length, left, rest)
    return return_order


def _exact(length: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack on sums up to twice the budget; the nearest to it counts
    (the lower of two).  Each count is cut into 1, 2, 4, ... items, and each sum
    remembers the item that first reached it."""
    take = np.zeros(len(length), np.int64)
    most = 2 * budget
    by = np.full(most + 1, -1, np.int32)
    by[0] = 0
    items = [(0, 0)]
    for i in np.flatnonzero((left > 0) & (length > 0) & (length <= most)):
        n, k = min(int(left[i]), most // int(length[i])), 1
        while n > 0 and by[budget] < 0:
            k = min(k, n)
            step = k * int(length[i])
            if step <= most:
                fresh = np.flatnonzero((by[step:] < 0) & (by[:most + 1 - step] >= 0)) + step
                by[fresh] = len(items)
                items.append((int(i), k))
            n, k = n - k, k * 2
    reached = np.flatnonzero(by >= 0)
    at = int(reached[np.argmin(np.abs(reached - budget))])
    while at:
        i, k = items[by[at]]
        take[i] += k
        at -= k * int(length[i])
    return take


def _plan(histogram: pd.DataFrame) -> pd.DataFrame:
    """Copies of every document and extra documents per length, of one source."""
    size, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
    whole = min(int(target // size), MAX_REPEATS) if size else 0
    budget = int(round(target - whole * size)) if size and whole < MAX_REPEATS else 0
    extra = knapsack(histogram["size"], histogram["n"], budget)
    return pd.DataFrame({"source": histogram["source"], "size": histogram["size"], "n": histogram["n"],
                         "whole": whole, "extra": extra}).astype({"whole": "int64", "extra": "int64"})


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row, and the
    columns ``carry`` that tell rows of one key apart.

    ``taken`` counts the words that the mix takes from the row: its size times
    0 to 3.  A null text has size 0; null sources form one source; rows of size
    0 are taken 0 words.  Repeated rows each count.  An empty table gives no
    rows; a table without a word gives targets and takes of 0.  Other columns
    are never read.  The same rows and seed give the same mix.
    """
    rows = written(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                               word_count(F.col(text)).alias("size"), *carry)
                   .withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"))), "mix-sizes")
    targets = written(source_targets(rows), "mix-targets")
    same = F.col("h.source").eqNullSafe(F.col("t.source"))
    histogram = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    histogram = histogram.alias("h").join(targets.alias("t"), same).select("h.*", "t.source_size", "t.target")
    plan = written(histogram.groupBy("source").applyInPandas(
        _plan, "source string, size long, n long, whole long, extra long"), "mix-plan")
    # ranks are only needed where a part of a group is taken; they are counted
    # per hash range first, so one group is never sorted in one task
    part = plan.where("extra > 0 AND extra < n").select("source", "size", "extra")
    bucket = F.shiftrightunsigned(F.col("_h"), 64 - RANK_BUCKETS.bit_length() + 1)
    ranked = rows.alias("r").join(part.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))
                                  & (F.col("r.size") == F.col("p.size"))).select("r.*", "p.extra")
    ranked = ranked.withColumn("_b", bucket)
    per_bucket = ranked.groupBy("source", "size", "_b", "extra").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy("source", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(up_to), F.lit(0)))
    cutting = written(per_bucket.select("source", "size", "_b", (F.col("extra") - F.col("_before")).alias("_want"), "_n")
                      .where("_want > 0"), "mix-cuts")
    key_of = ["source", "size", "_b"]
    in_cut = rows.withColumn("_b", bucket).alias("r").join(
        cutting.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))
        & (F.col("r._b") == F.col("c._b"))).select("r.*", "c._want", "c._n")
    whole_buckets = in_cut.where("_want >= _n").select("doc_id", "source", "size")
    order = Window.partitionBy(*key_of).orderBy("_h", "doc_id")
    cut_buckets = in_cut.where("_want < _n").withColumn("_r", F.row_number().over(order)).where("_r <= _want").select(
        "doc_id", "source", "size")
    once_more = whole_buckets.unionByName(cut_buckets).groupBy("doc_id", "source", "size").agg(
        F.count(F.lit(1)).alias("_more"))
    return _taken(rows, targets, plan, once_more, carry)


def _taken(rows: DataFrame, targets: DataFrame, plan: DataFrame, once_more: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The passes of each row.  Rows that agree in doc_id, source and size are
    told apart by a running number, as only some of them may be taken."""
    whole = plan.select("source", "size", "whole", (F.col("extra") >= F.col("n")).alias("_all"))
    rows = rows.withColumn("_k", F.row_number().over(
        Window.partitionBy("doc_id", "source", "size").orderBy("_h")))
    out = rows.alias("r").join(whole.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))
                               & (F.col("r.size") == F.col("p.size")), "left")
    out = out.join(once_more.alias("m"), F.col("r.doc_id").eqNullSafe(F.col("m.doc_id"))
                   & F.col("r.source").eqNullSafe(F.col("m.source")) & (F.col("r.size") == F.col("m.size")), "left")
    out = out.join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    more = F.when(F.col("p._all"), 1).otherwise((F.col("r._k") <= F.coalesce(F.col("m._more"), F.lit(0))).cast("int"))
    passes = F.coalesce(F.col("p.whole"), F.lit(0)) + more
    return out.select("r.doc_id", F.col("r.size").alias("size"), "t.source_size", "t.target",
                      (F.col("r.size") * passes).cast("long").alias("taken"), *[f"r.{c}" for c in carry])
