"""Alignment of two tokenisers over the bytes of each text, and how often each
pair of their ids stands together in the corpus.

The first tokeniser (a) is byte-level BPE from a ``tokenizers`` file and reads
space + text; the second (b) is a SentencePiece model that adds the space
itself.  Special tokens are never made; their strings are plain text.  Where
both tokenisations end at the same byte they are cut into groups
(``cuts.shared_cuts``); every a token and b token of a group are linked.

Texts that are null or empty, or whose tokens do not join to the bytes of
space + text (a model that normalises), have no tokens: zeros and ''.  Equal
rows and null keys count as rows of their own; only the key and text columns
are read.  An empty table gives an empty result.  A very long text is a slice
of its own and costs about 200 bytes of memory a byte; a stretch without a
shared cut costs its tokens of a times those of b.

Spark's part: one pass tokenises and aligns slices of texts and writes one row
per slice, in which the pairs of all its texts are numbered.  Counts of id
pairs are summed over slices, the highest of each a id (as many rows as the
vocabulary has) is joined to them, and the counts go back to the slices that
hold the pair, never to the driver.  The tokenisers run once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.cuts import shared_cuts
from rentgrid.llm.tables import sized, small_batches, written

#: Bytes of text per slice and of those worked on at a time.
SLICE_BYTES, PART_BYTES = 4 << 20, 256 << 10
_WIDTH = 6  # digits of an id and what separates it from the next


class Tokenizers(NamedTuple):
    path_a: str
    first: object
    second: object
    bytes_a: list
    bytes_b: list
    length_a: np.ndarray
    length_b: np.ndarray


def _byte_of() -> dict:
    """The byte that each character of a byte-level vocabulary stands for:
    printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_ranks(path: str) -> dict:
    """Token bytes and ids of a byte-level BPE file whose merges are its
    vocabulary in order, so that ids are merge ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, byte = spec["model"], _byte_of()
    split = spec["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if not (model["type"] == "BPE" and spec["normalizer"] is None and split.get("type") == "ByteLevel"
            and split.get("use_regex") and not split.get("add_prefix_space")
            and all(model["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(merges))):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


@functools.cache
def load(path_a: str, path_b: str) -> Tokenizers:
    """Both tokenisers, once per worker."""
    import sentencepiece
    import tiktoken

    ranks = byte_level_ranks(path_a)
    first = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    second = sentencepiece.SentencePieceProcessor(model_file=path_b)
    bytes_a = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        bytes_a[i] = token
    bytes_b = []
    for i in range(second.get_piece_size()):
        piece = second.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokenizers(path_a, first, second, bytes_a, bytes_b, np.array([len(t) for t in bytes_a]), np.array([len(t) for t in bytes_b]))


@functools.cache
def _slow_first(path: str):
    """The first tokeniser by its own library."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def _ids_a(tok: Tokenizers, text: str) -> np.ndarray:
    """Ids of a; white space runs too long for the fast library's pattern
    search are read by the file's own, which gives the same ids."""
    try:
        return tok.first.encode_to_numpy(text)
    except ValueError:
        return np.array(_slow_first(tok.path_a).encode(text, add_special_tokens=False).ids)


class Aligned(NamedTuple):
    """Texts aligned: per text the token, group and link counts and the digest
    of its groups; per text and id pair (``pair`` = a * 65536 + b) the links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digest: list
    size: np.ndarray
    pair: np.ndarray
    links: np.ndarray


@functools.cache
def _printed(ids: int):
    """Rows of ``_WIDTH`` bytes, for each id times four separators, and how
    many bytes of a row count."""
    table, length = np.zeros((ids * 4, _WIDTH), np.uint8), np.zeros(ids * 4, np.int64)
    for i in range(ids):
        for k, sep in enumerate(",|;"):
            text = f"{i}{sep}".encode()
            table[i * 4 + k, :len(text)] = list(text)
            length[i * 4 + k] = len(text)
    return table, length


def align(tok: Tokenizers, texts: list) -> Aligned:
    """Tokens, groups and links of texts (null: none)."""
    n = len(texts)
    counts = np.zeros((4, n), np.int64)
    digest, size = [""] * n, np.zeros(n, np.int64)
    have = [i for i, t in enumerate(texts) if t]
    wanted = [" " + texts[i] for i in have]
    ids_a = [_ids_a(tok, t) for t in wanted]
    ids_b = tok.second.encode([texts[i] for i in have], num_threads=1)
    good = [k for k, t in enumerate(wanted)
            if b"".join([tok.bytes_a[i] for i in ids_a[k].tolist()]) == (raw := t.encode())
            and b"".join([tok.bytes_b[i] for i in ids_b[k]]) == raw]
    if not good:
        return Aligned(*counts, digest, size, np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.array(have)[good]
    stops_a = np.cumsum([len(ids_a[k]) for k in good])
    stops_b = np.cumsum([len(ids_b[k]) for k in good])
    a = np.concatenate([ids_a[k] for k in good]).astype(np.int64)
    b = np.fromiter(itertools.chain.from_iterable(ids_b[k] for k in good), np.int64, stops_b[-1])
    cut_a, cut_b = shared_cuts(np.cumsum(tok.length_a[a]), np.cumsum(tok.length_b[b]), stops_a, stops_b)
    in_a, in_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    owner = np.searchsorted(stops_a, cut_a)  # the text of each group
    counts[0, at], counts[1, at] = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    counts[2, at] = np.bincount(owner, minlength=len(good))
    per_group = in_a * in_b
    links_to = np.cumsum(per_group)
    counts[3, at] = np.diff(links_to[np.searchsorted(owner, np.arange(len(good)), "right") - 1], prepend=0)

    group = np.repeat(np.arange(len(per_group)), per_group)
    k = np.arange(links_to[-1]) - np.repeat(links_to - per_group, per_group)
    pair = (a[(cut_a - in_a)[group] + k // in_b[group]] << 16) | b[(cut_b - in_b)[group] + k % in_b[group]]
    found, links = np.unique((owner[group] << 32) | pair, return_counts=True)
    size[at] = np.bincount(found >> 32, minlength=len(good))

    table, length = _printed(max(len(tok.bytes_a), len(tok.bytes_b)))
    code = np.empty(len(a) + len(b), np.int64)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[cut_a - 1], mark_b[cut_b - 1] = 1, 2
    code[np.arange(len(a)) + np.repeat(cut_b - in_b, in_a)] = a * 4 + mark_a
    code[np.arange(len(b)) + np.repeat(cut_a, in_b)] = b * 4 + mark_b
    used = length[code]
    printed = table[code][np.arange(_WIDTH) < used[:, None]].tobytes()
    ends = np.cumsum(used)[stops_a + stops_b - 1]
    start = 0
    for i, end in zip(at.tolist(), ends.tolist()):
        digest[i] = hashlib.sha256(printed[start:end - 1]).hexdigest()
        start = end
    return Aligned(*counts, digest, size, found & 0xFFFFFFFF, links)


def _slices(batches, key_type: pa.DataType, paths: tuple, slice_bytes: int):
    """One row per slice of texts."""
    tok = load(*paths)
    number = itertools.count(TaskContext.get().partitionId() << 32)
    keys, texts, held = [], [], 0
    done: list[Aligned] = []

    def flush():
        nonlocal texts, held
        if texts:
            done.append(align(tok, texts))
            texts, held = [], 0

    def row():
        pair = np.concatenate([x.pair for x in done])
        pairs, where, docs = np.unique(pair, return_inverse=True, return_counts=True)
        each = {name: np.concatenate([getattr(x, name) for x in done]) for name in ("n_a", "n_b", "n_groups", "n_links", "size")}
        cells = {"slice": pa.array([next(number)], pa.int64()), "keys": pa.array([keys], pa.list_(key_type)),
                 "digest": pa.array([[d for x in done for d in x.digest]], pa.list_(pa.string()))}
        cells |= {name: pa.array([v], pa.list_(pa.int64())) for name, v in (each | {"pairs": pairs, "docs": docs}).items()}
        entries = np.concatenate((where, np.concatenate([x.links for x in done]))).astype(np.int32)
        cells["entries"] = pa.array([entries.tobytes()], pa.binary())
        return pa.RecordBatch.from_pydict(cells)

    total = 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            value = text.as_py()
            keys.append(key)
            texts.append(value)
            many = text.as_buffer().size if value else 0
            held, total = held + many, total + many
            if held >= min(PART_BYTES, slice_bytes):
                flush()
            if total >= slice_bytes:
                flush()
                yield row()
                keys, done, total = [], [], 0
    flush()
    if keys:
        yield row()


def _results(batches, key: str, key_type: pa.DataType):
    """Rows sorted by slice and position: a slice's own row, then the value of
    each of its pairs (count * 2, and 1 more for the highest of its a id)."""
    head, values = None, []

    def finish():
        value = np.concatenate(values) if values else np.zeros(0, np.int64)
        size = np.array(head["size"], np.int64)
        entries = np.frombuffer(head["entries"], np.int32)
        where, links = entries[:len(entries) // 2], entries[len(entries) // 2:].astype(np.int64)
        stop = np.cumsum(size)

        def per_text(x):
            total = np.append(0, np.cumsum(x))
            return total[stop] - total[stop - size]
        return pa.RecordBatch.from_pydict({
            key: pa.array(head["keys"], key_type), **{c: pa.array(head[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
            "n_best": per_text(links * (value[where] & 1)), "count_sum": per_text(links * (value[where] >> 1)),
            "groups_sha256": pa.array(head["digest"], pa.string())})

    for batch in batches:
        position = batch.column("position").to_numpy()
        value = batch.column("value").to_numpy(zero_copy_only=False)
        at = 0
        for first in [*np.flatnonzero(position < 0).tolist(), len(position)]:
            if first > at:
                values.append(value[at:first].astype(np.int64))
            if first < len(position):
                if head:
                    yield finish()
                head, values = {c: batch.column(c)[first].as_py() for c in batch.schema.names}, []
            at = first + 1
    if head:
        yield finish()


def cross_align(table: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
                slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of every row."""
    small_batches(table.sparkSession)
    docs = table.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType
    arrow_kind = _arrow_type(kind)
    schema = (f"slice long, keys array<{kind.simpleString()}>, digest array<string>, n_a array<long>, n_b array<long>, "
              "n_groups array<long>, n_links array<long>, size array<long>, pairs array<long>, docs array<long>, entries binary")
    paths = (path_a, path_b)
    slices = written(docs.mapInArrow(lambda batches: _slices(batches, arrow_kind, paths, slice_bytes), schema), "align-slices")
    counts = slices.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count"))
    counts = written(counts.withColumn("a", F.shiftright("pair", 16)), "align-counts")
    highest = written(counts.groupBy("a").agg(F.max("count").alias("highest")), "align-highest")
    value = F.col("count") * 2 + (F.col("count") == F.col("highest")).cast("long")
    counts = counts.join(sized(highest), "a").select("pair", value.alias("value"))
    asked = slices.select("slice", F.posexplode("pairs").alias("position", "pair"))
    answers = asked.join(counts, "pair").select("slice", "position", "value")
    heads = slices.drop("pairs", "docs").withColumn("position", F.lit(-1))
    rows = heads.unionByName(answers, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "position")
    out = (f"{key} {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
    return rows.mapInArrow(lambda batches: _results(batches, key, arrow_kind), out)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)
