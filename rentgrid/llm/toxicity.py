"""Toxicity by weak supervision (operator 6).

Many weak voters look at a document: word lists and word stems (a given list,
and lists mined from the labelled rows that may be used), each list cut into
several voters, patterns such as repeated hits or hits in one sentence, and, on
the sample that the model is fitted on, the given label as one more voter that
may err.  A generative label model over the vote patterns estimates how often
each voter fires on toxic and on clean documents.  Voters that still go
together within a class are found by their residual correlation and modelled
jointly.  The posteriors are the labels of a linear classifier over the listed
words and stems; that classifier scores all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm import arrowtext as at
from rentgrid.llm.labelled import SAMPLE, held_out, training_sample
from rentgrid.llm.tables import small_batches, written

#: A start list of insults, by kind.
SEED_LEXICON = {
    "intellect": ("idiot", "moron", "stupid", "imbecile", "dumb"),
    "worth": ("worthless", "loser", "pathetic", "useless"),
    "disgust": ("disgusting", "scum", "trash", "filth", "vermin"),
    "ridicule": ("clown", "buffoon", "fool"),
}
STEMS = (4, 5, 6)
#: A mined word or stem must pass this log-likelihood ratio against the base
#: rate, and this share of its documents must be toxic.
MIN_EVIDENCE, MIN_PRECISION = 30.0, 0.9
MAX_MINED = 2000
#: Mined words are dealt to so many voters, by frequency.
MINED_VOTERS = 6
#: Voters whose votes correlate above this within a class are modelled jointly.
CORRELATED, MAX_JOINT = 0.15, 3

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words) -> set[str]:
    """Words, and stems marked by a trailing star."""
    out = set(words)
    for n in STEMS:
        out |= {w[:n] + "*" for w in words if len(w) > n}
    return out


def _count(batches):
    """Documents per feature and label, in each task; documents that share
    their least shingle (copies, mostly) count once."""
    seen, toxic, clean, n = set(), Counter(), Counter(), [0, 0]
    for b in batches:
        least = []
        for _, data, starts, ends in at.slices(b.column(0)):
            data = at.lower(data)
            begin, end, row = at.words(data, starts)
            value, owner = at.shingles(at.range_hash(at.prefix_hash(data), begin, end), row, len(starts), 5)
            least += at.per_row(np.minimum, value, np.bincount(owner, minlength=len(starts)), np.uint64(0)).tolist()
        for text, y, mark in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), least, strict=True):
            if mark in seen:
                continue
            seen.add(mark)
            (toxic if y else clean).update(features(set(tokens(text))))
            n[1 if y else 0] += 1
    names = [None, *(toxic | clean)]
    yield pa.RecordBatch.from_arrays([
        pa.array(names, pa.string()), pa.array([n[1], *(toxic[x] for x in names[1:])], pa.int64()),
        pa.array([n[0], *(clean[x] for x in names[1:])], pa.int64())], ["feature", "toxic", "clean"])


def mine(sample: DataFrame) -> list[tuple[str, int, int]]:
    """Words and stems that mark toxic documents, most telling first."""
    counts = written(sample.select("text", "y").mapInArrow(_count, "feature string, toxic long, clean long")
                     .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
                     "toxicity-counts")
    total = counts.where("feature IS NULL").first()
    if not total or not total.toxic:
        return []
    base = (total.toxic + 1) / (total.toxic + total.clean + 2)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = 2 * (F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log(
        (1 - share) / (1 - base))).otherwise(0.0))
    rows = counts.where("feature IS NOT NULL AND toxic > 0").withColumn("gain", gain).where(
        (F.col("gain") >= MIN_EVIDENCE) & (share >= MIN_PRECISION)).orderBy(F.desc("gain"), "feature").limit(MAX_MINED)
    found = [(r.feature, r.toxic, r.clean) for r in rows.collect()]
    # a longer stem adds nothing to a shorter one that already marks its documents
    kept: list[tuple[str, int, int]] = []
    names: set[str] = set()
    for name, a, b in sorted(found, key=lambda x: (len(x[0].rstrip("*")), x[0])):
        stem = name.rstrip("*")
        if not any(stem[:n] + "*" in names for n in STEMS if n < len(stem)):
            kept.append((name, a, b))
            names.add(name)
    return sorted(kept, key=lambda x: (-x[1], x[0]))


class Voters:
    """Votes of one document: one bit per voter, and the hits they rest on."""

    def __init__(self, mined: list[str]):
        self.lists = [frozenset(x) for x in SEED_LEXICON.values()]
        self.lists += [frozenset(mined[i::MINED_VOTERS]) for i in range(min(MINED_VOTERS, len(mined)))]
        self.vocabulary = sorted(set().union(*self.lists)) if self.lists else []
        self.index = {f: i for i, f in enumerate(self.vocabulary)}
        self.known = frozenset(self.vocabulary)
        self.count = len(self.lists) + 3

    def hits(self, words: list[str]) -> Counter:
        """How often each listed word or stem occurs."""
        distinct = set(words)
        found = distinct & self.known
        stems = {w for w in distinct if any(len(w) > n and w[:n] + "*" in self.known for n in STEMS)}
        out: Counter = Counter()
        if found or stems:
            for w in words:
                if w in found:
                    out[w] += 1
                if w in stems:
                    out.update(w[:n] + "*" for n in STEMS if len(w) > n and w[:n] + "*" in self.known)
        return out

    def votes(self, text: str, hits: Counter) -> int:
        bits = [any(f in voter for f in hits) for voter in self.lists]
        total = sum(hits.values())
        bits += [total >= 2, len(hits) >= 2]
        dense = False
        if total >= 2:
            dense = any(sum(self.hits(tokens(s)).values()) >= 2 for s in _SENTENCE.split(text))
        bits.append(dense)
        return sum(1 << i for i, b in enumerate(bits) if b)


class LabelModel:
    """Two classes; the votes of a clique of voters are one categorical
    variable given the class.  Fitted by expectation maximisation on counts of
    vote patterns.  The given labels are one of the voters."""

    def __init__(self, voters: int):
        self.cliques = [[v] for v in range(voters)]
        self.prior = 0.1
        self.table: list[np.ndarray] = []

    def _codes(self, bits: np.ndarray) -> list[np.ndarray]:
        return [sum((bits[:, v].astype(int) << j for j, v in enumerate(c)), np.zeros(len(bits), int))
                for c in self.cliques]

    def _em(self, bits, weight, posterior, rounds=60):
        codes = self._codes(bits)
        for _ in range(rounds):
            self.prior = float(np.clip((weight * posterior).sum() / weight.sum(), 1e-4, 0.5))
            self.table = []
            for c, code in zip(self.cliques, codes, strict=True):
                size = 1 << len(c)
                t = np.stack([np.bincount(code, weight * p, size) + 0.5 / size for p in (1 - posterior, posterior)])
                self.table.append(t / t.sum(1, keepdims=True))
            posterior = self._posterior(codes)
        return posterior

    def _posterior(self, codes):
        odds = np.full(len(codes[0]), math.log(self.prior / (1 - self.prior)))
        for t, code in zip(self.table, codes, strict=True):
            odds += np.log(t[1][code] / t[0][code])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def fit(self, patterns: np.ndarray, weight: np.ndarray, voters: int) -> np.ndarray:
        bits = (patterns[:, None] >> np.arange(voters)) & 1
        fired = bits.sum(1)
        posterior = np.where(fired >= 2, 0.9, np.where(fired == 1, 0.4, 0.01))
        posterior = self._em(bits, weight, posterior)
        self.cliques = self._correlated(bits, weight, posterior)
        return self._em(bits, weight, posterior)

    def _correlated(self, bits, weight, posterior):
        """Cliques of voters by residual correlation within a class."""
        voters = bits.shape[1]
        worst = np.zeros((voters, voters))
        for p in (1 - posterior, posterior):
            w = weight * p
            if w.sum() < 1:
                continue
            mean = (w[:, None] * bits).sum(0) / w.sum()
            off = bits - mean
            cov = (off * w[:, None]).T @ off / w.sum()
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            worst = np.maximum(worst, np.where(np.outer(spread, spread) > 1e-6,
                                               np.abs(cov) / np.outer(spread, spread), 0))
        of = list(range(voters))
        pairs = sorted(((-worst[i, j], i, j) for i in range(voters) for j in range(i) if worst[i, j] >= CORRELATED))
        for _, i, j in pairs:
            a, b = of[i], of[j]
            if a != b and of.count(a) + of.count(b) <= MAX_JOINT:
                of = [a if x == b else x for x in of]
        return [[v for v in range(voters) if of[v] == c] for c in dict.fromkeys(of)]


def _logistic(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 40):
    """Weights (bias last) of a linear classifier on soft labels, by Newton
    steps; rows are few distinct hit patterns with weights."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), l2 * weight.sum())
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + penalty * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _hit_vector(hits: Counter, index: dict[str, int]) -> list[float]:
    """What the classifier sees of each listed word or stem: log(1 + hits)."""
    return [(index[f], math.log1p(n)) for f, n in hits.items()]


def _voted(voters):
    def run(batches):
        for b in batches:
            votes, at_, value = [], [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = voters.hits(tokens(text))
                votes.append(voters.votes(text, hits) | (1 << voters.count if y else 0))
                vector = _hit_vector(hits, voters.index)
                at_.append([i for i, _ in vector])
                value.append([v for _, v in vector])
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.int64()), pa.array(at_, pa.list_(pa.int32())),
                                              pa.array(value, pa.list_(pa.float64()))], ["votes", "at", "value"])
    return run


class ToxicityModel:
    """Voters, label model and classifier, fitted on a bounded sample."""

    def __init__(self, sample: DataFrame):
        self.voters = Voters([name for name, _, _ in mine(sample)])
        rows = sample.select("text", "y").mapInArrow(_voted(self.voters), "votes long, at array<int>, value array<double>")
        rows = rows.collect()  # bounded by the sample
        self.weights, self.bias = np.zeros(len(self.voters.vocabulary)), -3.0
        self.label_model = LabelModel(self.voters.count + 1)
        if rows:
            patterns, inverse, count = np.unique([r.votes for r in rows], return_inverse=True, return_counts=True)
            posterior = self.label_model.fit(patterns, count.astype(float), self.voters.count + 1)[inverse]
            x = np.zeros((len(rows), len(self.weights)), np.float32)
            for i, r in enumerate(rows):
                x[i, r.at] = r.value
            used = np.flatnonzero((x > 0).any(0))  # words the sample lacks get the mean weight of the others
            fitted = _logistic(x[:, used].astype(float), posterior, np.ones(len(rows)), l2=1e-6)
            self.bias = float(min(fitted[-1], -1.0))
            self.weights[:] = max(1.0, float(fitted[:-1].mean())) if len(used) else 2.0
            self.weights[used] = fitted[:-1]
        else:
            self.weights[:] = 3.0

    def score(self, text: str) -> float:
        hits = self.voters.hits(tokens(text))
        odds = self.bias + sum(self.weights[i] * v for i, v in _hit_vector(hits, self.voters.index))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> ToxicityModel:
    """The model from at most ``limit`` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    return ToxicityModel(written(training_sample(docs, labels, "toxic", limit), "toxicity-sample"))


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null text counts as empty and gets the score of a text without hits;
    repeated rows get equal scores; an empty table gives no rows; other columns
    are never read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            scores = [sent.value.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not predicted toxic."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([sent.value.score(t or "") < THRESHOLD for t in b.column(where).to_pylist()],
                                    pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Scores from here on are toxic.
THRESHOLD = 0.7
