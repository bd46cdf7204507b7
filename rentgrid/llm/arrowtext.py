"""Vectorised reading of words in Arrow string columns.

The functions work on the UTF-8 bytes of a whole slice of rows at once with
numpy; no Python string is made.  White space is ASCII 0x20 and 0x09-0x0D, so
a word never splits inside a character.  Null texts are empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time (one longer text is a slice).
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

#: Base of the prefix polynomial (odd, so that it has an inverse mod 2**64).
_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def slices(column, max_bytes: int = SLICE_BYTES):
    """``(first row, bytes, starts, ends)`` per run of rows of about
    ``max_bytes``; starts and ends are positions in the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        part = data[offsets[first]:offsets[last]]
        at = offsets[first:last + 1] - offsets[first]
        yield first, part, at[:-1], at[1:]
        first = last


def give_back() -> None:
    """Hand memory that a task has freed back to the system: a Python worker
    lives on, idle, while later stages need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def words(data: np.ndarray, starts: np.ndarray):
    """Start and end of every word, and the row that it is in."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = starts[starts < len(data)]
    begins[firsts] = inside[firsts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    lasts = firsts[firsts > 0] - 1
    stops[lasts] = inside[lasts]
    begin = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit changes every output bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``P[i]``: sum of (byte + 1) * base**j over j < i, mod 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data) + 1)[:len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes [begin, end): equal bytes give equal hashes
    wherever they stand."""
    down = _power("down", pow(_BASE, -1, 1 << 64), len(prefix))
    value = (prefix[end] - prefix[begin]) * down[begin]
    return mix(value + mix((end - begin).astype(np.uint64)))


def shingles(word_hash: np.ndarray, row: np.ndarray, rows: int, k: int):
    """Hash of every run of ``k`` words of a row; a row with fewer words (but
    one) is one shingle.  Gives hashes and their rows, in text order."""
    n = np.bincount(row, minlength=rows).astype(np.int64)
    first = np.cumsum(n) - n
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    power = [np.uint64(pow(int(multiplier), j, 1 << 64)) for j in range(k)]
    total = len(word_hash)
    full = max(0, total - k + 1)
    value = np.zeros(full, np.uint64)
    for j in range(k):
        value += word_hash[j:j + full] * power[j]
    ok = row[:full] == row[k - 1:k - 1 + full] if full else np.zeros(0, bool)
    hashes, owner = [mix(value[ok])], [row[:full][ok]]
    for length in range(1, k):
        short = np.flatnonzero(n == length)
        if len(short):
            value = np.full(len(short), length, np.uint64)
            for j in range(length):
                value += word_hash[first[short] + j] * power[j]
            hashes.append(mix(mix(value)))
            owner.append(short)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    if len(owner) > len(ok[ok]):
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def distinct(hashes: np.ndarray, owner: np.ndarray):
    """The distinct (row, hash) pairs, by row and hash."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def per_row(ufunc, values: np.ndarray, counts: np.ndarray, empty=0) -> np.ndarray:
    """``ufunc.reduce`` over each row's run of values; ``empty`` for no values."""
    out = np.full(len(counts), empty, values.dtype)
    have = counts > 0
    if have.any():
        out[have] = ufunc.reduceat(values, (np.cumsum(counts) - counts)[have])
    return out
