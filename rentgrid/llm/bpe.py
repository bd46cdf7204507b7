"""Byte-level BPE encoding and decoding (operator 2).

Two tiers.  A minimal perfect hash over the vocabulary resolves every whole
pre-token that is itself a token.  The others are merged from single bytes: a
heap holds the possible merges by rank, and a doubly linked list of byte spans
makes a merge two link changes.  Equal pre-tokens of a task are encoded once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.tables import small_batches

#: Pieces whose ids a worker remembers, twice over, and their longest length.
CACHE = 150_000
LONGEST_KEPT = 64
#: Vocabulary files above this are not shipped to the executors.
MAX_VOCABULARY_BYTES = 64 << 20


_SPACED = re.compile(r"\s ")
_CUTS = re.compile(r"(?<=\S)(?= )").split


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    Keys go to buckets by one half of a 64-bit hash; each bucket, largest
    first, gets the smallest displacement that puts its keys on free slots.
    A slot keeps its key and value; the key tells members from others.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault((h >> 32) % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            d = 0
            while True:
                at = [self._slot(hashes[i], d) for i in members]
                if len(set(at)) == len(at) and all(self.keys[s] is None for s in at):
                    break
                d += 1
            self.shift[bucket] = d
            for i, s in zip(members, at, strict=True):
                self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        slot = self._slot(h, self.shift[(h >> 32) % self.buckets])
        return self.values[slot] if self.keys[slot] == key else None


class Recent:
    """What was encoded lately: two generations of at most ``CACHE`` short
    pieces; the older one is dropped when the newer is full."""

    def __init__(self):
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def get(self, piece: str):
        ids = self.new.get(piece)
        if ids is None and (ids := self.old.get(piece)) is not None:
            self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(piece) <= LONGEST_KEPT:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[piece] = ids


class Encoder:
    """Encodes texts with the ranks of a vocabulary.

    Built once on the driver and sent to the executors as it is; its size is
    that of the vocabulary.
    """

    def __init__(self, vocabulary: bytes, pattern: str):
        pairs = [line.split() for line in vocabulary.splitlines() if line]
        keys, ranks = [base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs]
        self.whole = PerfectHash(keys, ranks)
        self.pattern = pattern
        self._open()

    def _open(self):
        self.ranks = dict(zip(self.whole.keys, self.whole.values, strict=True))
        self.token = {r: k for k, r in self.ranks.items()}
        self.split = regex.compile(self.pattern).findall
        self.names = {r: str(r) for r in self.token}
        self.cache, self.units = Recent(), Recent()

    def __getstate__(self):
        return {"whole": self.whole, "pattern": self.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no token: always the lowest-ranked pair
        next, the leftmost of equal ones.  ``after[i]`` is where the span that
        begins at i ends (0 once it is merged into the span before it)."""
        rank, n = self.ranks.get, len(piece)
        m = n + 1
        after, before = list(range(1, m)), list(range(-1, n - 1))
        # rank, begin and end in one number, so that the heap compares numbers
        heap = [(r * m + i) * m + i + 2 for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            at, end = divmod(pop(heap), m)
            i = at % m
            mid = after[i]
            if not mid or mid >= n or after[mid] != end:
                continue  # one of its two spans has changed since
            after[mid], after[i] = 0, end
            if end < n:
                before[end] = i
                if (r := rank(piece[i:after[end]])) is not None:
                    push(heap, (r * m + i) * m + after[end])
            left = before[i]
            if left >= 0 and (r := rank(piece[left:end])) is not None:
                push(heap, (r * m + left) * m + end)
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i:after[i]]))
            i = after[i]
        return tuple(out)

    def _pieces(self, text: str) -> tuple[int, ...]:
        """Ids of a text, pre-token by pre-token."""
        out: list[int] = []
        for piece in self.split(text):
            ids = self.cache.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                whole = self.whole.get(raw)
                ids = (whole,) if whole is not None else self.merge(raw)
                self.cache.keep(piece, ids)
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text.

        No pre-token has a space behind its first character unless white space
        stands before that space.  So a text can be cut before every other
        space, and what lies between two cuts is remembered as a whole.
        """
        if _SPACED.search(text):
            first, *rest = _CUTS(text)
            rest = [unit[1:] for unit in rest]
        else:
            first, *rest = text.split(" ")
        out = list(self._pieces(first))
        units, get = self.units, self.units.get
        for unit in rest:
            ids = get(unit)
            if ids is None:
                ids = self._pieces(" " + unit)
                units.keep(unit, ids)
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_vocabulary(path: str) -> bytes:
    """The rank file; its size is checked, as it is shipped to every executor."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of every row; a null text has no ids."""
    sent = docs.sparkSession.sparkContext.broadcast(Encoder(read_vocabulary(path), pattern))
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = sent.value
        for b in batches:
            ids, at = [], [0]
            for t in b.column(1):
                ids.append(np.asarray(encoder.encode(t.as_py() or ""), np.int32))
                at.append(at[-1] + len(ids[-1]))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, bytes`` of every row of ``doc_id, ids``."""
    sent = encoded.sparkSession.sparkContext.broadcast(Encoder(read_vocabulary(path), pattern))

    def run(batches):
        encoder = sent.value
        for b in batches:
            texts = [encoder.decode(x.values.to_numpy() if x.is_valid else ()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())],
                                             ["doc_id", "ids", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
               with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and
    ``ids`` (array of int) if asked for.

    Each text is encoded and its ids are decoded in one pass.  ``ids_sha256``
    is of the decimal ids joined by commas, ``decoded_sha256`` of the bytes
    that the ids decode to.  Null and empty texts have no tokens; repeated rows
    give repeated rows; an empty table gives none; other columns are never
    read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Encoder(read_vocabulary(path), pattern))
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        encoder = sent.value
        name = encoder.names.__getitem__
        for b in batches:
            counts, ids_sha, text_sha, kept = [], [], [], []
            for t in b.column(1):
                ids = encoder.encode(t.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                       pa.array(text_sha, pa.string())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
