"""Quality by Bradley-Terry pairwise ranking (operator 5).

A text is described by shares of characters, words and lines (symbols,
capitals, separators, repeats and so on), each also cut at a few quantiles of
the sample so that a linear score can bend.  Of two documents the better one
wins with a probability that is logistic in the difference of their scores; the
weights are fitted on pairs of labelled documents, as logistic loss on feature
differences.  The threshold is a quantile of the sample's scores: the share of
documents labelled bad.  The reported score is logistic around the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm import arrowtext as at
from rentgrid.llm.labelled import SAMPLE, held_out, training_sample
from rentgrid.llm.tables import small_batches, written

#: Scores from here on are predicted 1.
THRESHOLD = 0.5
#: Preference pairs that the ranking is fitted on, at most, and their seed.
PAIRS, SEED = 60_000, 5
KNOTS = (0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98)

_CLASSES = {
    "capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~=+\\{}[]_",
    "bar": b"|",
    "shout": b"!?",
    "stop": b".",
    "comma": b",;:",
    "quote": b"\"'()-/",
}
_TABLE = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in _CLASSES.items()}
NAMES = [*_CLASSES, "wide_capital", "space", "word_length", "line_length", "words", "distinct_words", "repeated_lines",
         "repeated_runs", "capital_words", "one_letter_words", "long_words", "symbol_words", "common_words"]


def _repeats(hashes, owner):
    """Values that equal an earlier one of the same row."""
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(hashes), bool)
    a, b = order[1:], order[:-1]
    same[a] = (hashes[a] == hashes[b]) & (owner[a] == owner[b])
    return same


def describe(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of numbers (``NAMES``) per text; an empty text is all zeros."""
    rows = len(starts)
    if not len(data):
        return np.zeros((rows, len(NAMES)))
    length = ends - starts
    owner_bytes = np.repeat(np.arange(rows), length)

    def per_text(mask):
        return np.bincount(owner_bytes[mask], minlength=rows).astype(float)

    chars = np.maximum(per_text((data & 0xC0) != 0x80), 1)
    out = {name: per_text(table[data]) / chars for name, table in _TABLE.items()}
    lead = np.zeros(len(data), bool)
    lead[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    out["wide_capital"] = per_text(lead) / chars
    out["space"] = per_text((data == 32) | ((data >= 9) & (data <= 13))) / chars
    begin, end, row = at.words(data, starts)
    n = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(n, 1)
    size = end - begin
    prefix = at.prefix_hash(at.lower(data))
    word = at.range_hash(prefix, begin, end)
    share = lambda mask: np.bincount(row[mask], minlength=rows) / some
    capital = _TABLE["capital"][data] | lead
    capitals = np.concatenate([[0], np.cumsum(capital)])
    symbols = np.concatenate([[0], np.cumsum(_TABLE["symbol"][data])])
    out["word_length"] = np.log1p(np.bincount(row, size, rows) / some)
    out["words"] = np.log1p(n)
    out["distinct_words"] = 1 - share(_repeats(word, row))
    out["capital_words"] = share((capitals[end] - capitals[begin]) * 2 > size)
    out["one_letter_words"] = share(size == 1)
    out["long_words"] = share(size > 12)
    out["symbol_words"] = share(symbols[end] - symbols[begin] > 0)
    out["common_words"] = share(size <= 3)
    runs, run_row = at.shingles(word, row, rows, 5)
    out["repeated_runs"] = np.bincount(run_row[_repeats(runs, run_row)], minlength=rows) / some
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([starts[length > 0], breaks + 1]))
    line_start = np.unique(line_start[line_start < len(data)])
    line_end = np.append(line_start[1:], len(data))
    line_row = np.searchsorted(starts, line_start, "right") - 1
    line = at.range_hash(prefix, line_start, line_end)
    lines = np.maximum(np.bincount(line_row, minlength=rows), 1)
    out["line_length"] = np.log1p(chars / lines)
    out["repeated_lines"] = np.bincount(line_row[_repeats(line, line_row)], minlength=rows) / lines
    return np.stack([out[name] for name in NAMES], 1)


class Ranking:
    """Bradley-Terry scores, linear in the bent features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
        self.knots = np.quantile(x, KNOTS, axis=0) if len(x) else np.zeros((len(KNOTS), len(NAMES)))
        phi = self._bend(x)
        self.weights = np.zeros(phi.shape[1])
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.cut, self.steep = 0.0, 1.0
        if len(good) and len(bad):
            rng = np.random.default_rng(SEED)
            n = min(PAIRS, 20 * max(len(good), len(bad)))
            self.weights = _fit_pairs(phi[rng.choice(good, n)] - phi[rng.choice(bad, n)])
            raw = phi @ self.weights
            # the threshold: the quantile of scores that leaves the labelled share below
            ranked = np.sort(raw)
            self.cut = float((ranked[len(bad) - 1] + ranked[min(len(bad), len(raw) - 1)]) / 2)
            self.steep = 1.0 / max(1e-6, float(raw.std()))

    def _bend(self, x: np.ndarray) -> np.ndarray:
        flat = np.clip((x - self.mean) / self.scale, -4, 4)
        steps = [(x > k) - 0.5 for k in self.knots]
        return np.hstack([flat, *steps])

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = (self._bend(x) @ self.weights - self.cut) * self.steep * 4
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _fit_pairs(difference: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights with which the first of each pair wins, by Newton steps on the
    logistic loss of the score differences."""
    beta = np.zeros(difference.shape[1])
    n = len(difference)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(difference @ beta, -30, 30)))
        gradient = -(difference.T @ p) / n + l2 * beta
        hessian = (difference * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ difference / n + l2 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-5:
            break
    return beta


def _described(batches):
    for b in batches:
        for first, data, starts, ends in at.slices(b.column(0)):
            x = describe(data, starts, ends)
            yield pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64())),
                b.column(1).slice(first, len(starts))], ["x", "y"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Ranking:
    """The ranking from at most ``limit`` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    sample = written(training_sample(docs, labels, "quality", limit), "quality-sample")
    rows = sample.select("text", "y").mapInArrow(_described, "x array<double>, y int").collect()  # bounded by the sample
    return Ranking(np.array([r.x for r in rows]).reshape(len(rows), len(NAMES)), np.array([r.y for r in rows]))


def score(docs: DataFrame, ranking: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null text counts as empty; an empty text is scored like any other, from
    features that are all zero; repeated rows get equal scores; an empty table
    gives no rows; other columns are never read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        for b in batches:
            for first, data, starts, ends in at.slices(b.column(1)):
                scores = sent.value.score(describe(data, starts, ends))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(starts)), pa.array(scores)],
                                                 ["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
