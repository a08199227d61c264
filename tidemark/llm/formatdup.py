"""Duplicates hidden by formatting, found by progressive partition refinement.

Level 1 puts every row into a class by two cheap invariants of its text, the stripped length
and the histogram of its letters and digits, both counted on the raw bytes without building a
stripped string.  Only rows of classes with several members go on.  Level 2 builds the costly
key (stripped text and tag set, as a 128-bit digest) for those rows alone and groups by it.

Rows of one final group have equal invariants, so no group is ever torn by level 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.operators.signatures import stripped

MIN_KEY_LENGTH = 20

_CLASSES = 37  # a-z, 0-9, any other letter or digit
_NONE = 255


def _byte_classes() -> np.ndarray:
    t = np.full(256, _NONE, np.uint8)
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = i
    for i in range(10):
        t[ord("0") + i] = 26 + i
    return t


_BYTE_CLASS = _byte_classes()
#: One odd multiplier for each class: the weighted count is a hash of the histogram.
_WEIGHTS = np.random.default_rng(20).integers(1, 2**62, _CLASSES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _histogram_of(text: str) -> np.ndarray:
    h = np.zeros(_CLASSES, np.int64)
    for ch in stripped(text):
        c = _BYTE_CLASS[ord(ch)] if ch < "\x80" else _CLASSES - 1
        h[c] += 1
    return h


def histograms(texts: pa.Array) -> np.ndarray:
    """One row of class counts for each text (nulls: zeros)."""
    texts = texts.cast(pa.large_utf8())
    n = len(texts)
    out = np.zeros((n, _CLASSES), np.int64)
    if not n:
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    if offsets[-1] == offsets[0]:
        return out
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    step = 1 << 22  # bytes at a time, so that the helper arrays stay small
    row = 0
    wide = np.zeros(n, bool)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + step, side="right")) - 1)
        part = data[at[row] : at[end]]
        owner = np.repeat(np.arange(end - row, dtype=np.int64), np.diff(at[row : end + 1]))
        wide[row + owner[part >= 128]] = True
        cls = _BYTE_CLASS[part]
        keep = cls != _NONE
        out[row:end] = np.bincount(owner[keep] * _CLASSES + cls[keep], minlength=(end - row) * _CLASSES).reshape(-1, _CLASSES)
        row = end
    for i in np.flatnonzero(wide):  # rows with characters beyond ASCII are counted by character
        text = texts[int(i)].as_py()
        out[i] = _histogram_of(text) if text is not None else 0
    return out


def _invariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = histograms(b.column(1))
        length = h.sum(axis=1)
        with np.errstate(over="ignore"):
            sig = (h.astype(np.uint64) * _WEIGHTS).sum(axis=1, dtype=np.uint64).view(np.int64)
        keep = pa.array(length >= MIN_KEY_LENGTH)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(length.astype(np.int32)), pa.array(sig)], names=["line_num", "key_length", "letters"]
        ).filter(keep)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = []
        for text, tags in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            tags = sorted({k for t in tags or () if t is not None and (k := stripped(t))})
            digests.append(hashlib.blake2b("\x00".join([stripped(text), *tags]).encode(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary())], names=["line_num", "full_key"])


def refine(log: DataFrame) -> DataFrame:
    """(line_num, full_key) of every row that shares both cheap invariants with another row.

    Null and short contents (stripped length under 20) are in no class; a null tag array counts
    as empty; rows without line_num are left out.
    """
    rows = log.select(F.col("line_num").cast("long"), F.col("content").cast("string"), F.col("tags").cast("array<string>")).where("line_num is not null and content is not null")
    cheap = rows.select("line_num", "content").mapInArrow(_invariants, "line_num long, key_length int, letters long")
    several = cheap.groupBy("key_length", "letters").agg(F.count("*").alias("members")).where("members > 1")
    alive = cheap.join(several, ["key_length", "letters"], "left_semi").select("line_num")
    return rows.join(alive, "line_num", "left_semi").mapInArrow(_keys, "line_num long, full_key binary")


def copies(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line_num, full_key) staged, and (full_key, first_line, n_copies) of groups of two or more.

    The group rows come from a map-side combined aggregation, so a group that holds a third of
    all rows costs one partial row for each task.
    """
    keyed = staged(refine(log), "format-keys")
    groups = keyed.groupBy("full_key").agg(F.min("line_num").alias("first_line"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return keyed, groups


def found(log: DataFrame) -> DataFrame:
    """Each further copy with the first row of its group: (first_line, copy_line).

    A row delivered twice under one line_num is no copy of itself.
    """
    keyed, groups = copies(log)
    return keyed.join(groups, "full_key").where("line_num <> first_line").select("first_line", F.col("line_num").alias("copy_line")).distinct()


def collapsed(log: DataFrame) -> DataFrame:
    """One row for each text and tag set: (line_num, n_copies), of the first of each group.

    Rows too short for a key stay as they are, with one copy.
    """
    keyed, groups = copies(log)
    ids = log.select(F.col("line_num").cast("long")).where("line_num is not null").distinct()
    later = keyed.join(groups, "full_key").where("line_num <> first_line").select("line_num")
    firsts = groups.select(F.col("first_line").alias("line_num"), "n_copies")
    return ids.join(later, "line_num", "left_anti").join(firsts, "line_num", "left").select("line_num", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
