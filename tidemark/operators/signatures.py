"""Signatures of word sets for overlap joins: rare-first prefixes, bitmaps and class keys.

A set of n distinct words gets
  * ``class_key``   64-bit sum of mixed word hashes; with n and the bitmap it names the set,
  * ``bitmap``      64 bits, one set bit per word; differing bits bound the overlap from above,
  * ``wide``        the same in 512 bits for sets of more than WIDE_FROM words, which fill 64; null for others,
  * ``prefix``      its first n - ceil(t n) + 1 words in the global order rare to frequent; two sets
                    with a Jaccard similarity of t or more share a word of their prefixes.

The global order is that of word counts, held in a table of a fixed number of hashed cells (``CELLS``), so what is
broadcast has a fixed size at any scale (16 MB).  Of a count its size class (LEVELS to a doubling) matters; within one the hash
decides.  Any fixed order keeps the join exact, the counts only make it fast.  In prefixes a word stands as the
upper 32 bits of its hash: words that share them only add candidates, which are verified on the words themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_BITS = 22
CELLS = 1 << CELL_BITS
LEVELS = 64
_ROWS = 1 << 20  # rows signed at once: with 12 bits for the level and 32 for the hash they fill 64
WIDE_FROM, WIDE = 128, 8

_WORD = re.compile(r"\w+")
#: For ASCII texts: letters to lower case, all but letters, digits and _ to spaces.
_PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() or c == 95 else 32 for c in range(128)) + bytes([32] * 128)


def bags(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, one after the other, and the number of each; texts of fewer than
    `least` distinct words have none."""
    find, digest = _WORD.findall, xxhash.xxh3_64_digest
    flat: list[bytes] = []
    n = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text is not None:
            if text.isascii():
                found = set(text.encode().translate(_PLAIN).split())
            else:
                found = {w.encode() for w in find(text.lower())}
            if len(found) >= least:
                n[i] = len(found)
                flat += map(digest, found)
    return np.frombuffer(b"".join(flat), ">u8").astype(np.uint64), n


_NOT_KEY = re.compile(r"[\W_]+")
_NOT_KEY_BYTES = bytes(c for c in range(128) if not chr(c).isalnum())


def stripped(text: str) -> str:
    """The letter key of a text: its letters and digits only, lower-cased."""
    if text.isascii():
        return text.lower().encode().translate(None, _NOT_KEY_BYTES).decode()
    return _NOT_KEY.sub("", text.lower())


def letter_keys(texts: pa.Array, least: int) -> pa.Array:
    """128-bit digests of the letter keys of `least` or more characters, else null."""
    digest, out = hashlib.blake2b, []
    for text in texts.to_pylist():
        text = text if text is not None else ""
        if text.isascii():  # stripped(), without the way through a string
            key = text.lower().encode().translate(None, _NOT_KEY_BYTES)
            out.append(digest(key, digest_size=16).digest() if len(key) >= least else None)
        else:
            key = stripped(text)
            out.append(digest(key.encode(), digest_size=16).digest() if len(key) >= least else None)
    return pa.array(out, pa.binary())


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_counts(texts: DataFrame, least: int) -> DataFrame:
    """(cell, n): how many of the texts (content, other columns are ignored) have a word of each cell; the tasks send partial sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for b in batches:
            cells, n = np.unique(_cell(bags(b.column(0), least)[0]), return_counts=True)
            total[cells] += n.astype(np.int32)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells].astype(np.int64))], names=["cell", "n"])

    rows = texts.select("content").mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return rows.select(F.col("cell").cast("int"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"))


def gathered(counts: DataFrame) -> np.ndarray:
    """The counts of all cells on the driver."""
    table = counts.select("cell", "n").toArrow()  # at most CELLS rows
    out = np.zeros(CELLS, np.int32)
    out[np.asarray(table["cell"])] = np.asarray(table["n"])
    return out


def word_counts(texts: DataFrame, least: int) -> np.ndarray:
    """cell_counts() on the driver."""
    return gathered(cell_counts(texts, least))


def _or_of(bit: np.ndarray, first: np.ndarray, some: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), np.uint64)
    if len(bit):
        out[some] = np.bitwise_or.reduceat(np.uint64(1) << bit, first[some])
    return out


def _wide(values: np.ndarray, n: np.ndarray, first: np.ndarray, least: int) -> pa.Array:
    """The wide bitmaps of the long sets, null for others."""
    long = np.flatnonzero(n > least)
    bits = np.zeros((len(long), WIDE), np.uint64)
    for k, i in enumerate(long):
        h = values[first[i] : first[i] + n[i]] >> np.uint64(13)
        np.bitwise_or.at(bits[k], ((h >> np.uint64(6)) & np.uint64(WIDE - 1)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    offsets = np.cumsum(np.concatenate([[0], np.where(n > least, WIDE, 0)])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(bits.reshape(-1).view(np.int64)), mask=pa.array(n <= least))


def signer(counts, num: int, den: int, least: int, min_key: int | None = None, wide_from: int = WIDE_FROM) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, content): id, class_key, n, bitmap, wide, prefix for a threshold of num / den.
    counts: a broadcast of word_counts().  Texts of fewer than `least` words are left out.  With min_key the digest of
    the letter key comes as well (null where it is shorter), and short texts stay, with n = 0 and no prefix.  Low
    thresholds leave much to the bit bounds, so they want wide bitmaps for smaller sets too (wide_from)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.minimum(LEVELS * np.log2(counts.value.astype(np.float32) + 1), 4095).astype(np.uint16)
        for b in (whole.slice(i, _ROWS) for whole in batches for i in range(0, whole.num_rows, _ROWS)):
            values, n = bags(b.column(1), least)
            if min_key is None:
                b = b.filter(pa.array(n > 0))
                n = n[n > 0]
            if not len(n):
                continue
            first = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            some = n > 0
            key = np.zeros(len(n), np.uint64)
            if len(values):
                with np.errstate(over="ignore"):  # a sum, so that the order of the words does not matter
                    mixed = (values ^ (values >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    key[some] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), first[some])
            bitmap = _or_of((values >> np.uint64(7)) & np.uint64(63), first, some)
            # row, level of the cell and upper half of the hash in one number
            ordered = np.sort(row << np.uint64(44) | level[_cell(values)].astype(np.uint64) << np.uint64(32) | values >> np.uint64(32))
            length = np.where(some, n - (num * n + den - 1) // den + 1, 0)
            chosen = ordered[np.arange(len(ordered)) - np.repeat(first, n) < np.repeat(length, n)]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(chosen.astype(np.uint32).view(np.int32)))
            out = {"id": b.column(0), "class_key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int32)), "bitmap": pa.array(bitmap.view(np.int64)), "wide": _wide(values, n, first, wide_from), "prefix": prefix}
            if min_key is not None:
                out["key"] = letter_keys(b.column(1), min_key)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


SIGNED = "id long, class_key long, n int, bitmap long, wide array<long>, prefix array<int>"
CLASS = ["class_key", "n", "bitmap"]


def classes(signed: DataFrame, *more: Column) -> DataFrame:
    """One row for each distinct set: (class_key, n, bitmap, rep, members, prefix, wide).

    Partial aggregation leaves one row of a large class for each task."""
    return signed.groupBy(*CLASS).agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.first("prefix").alias("prefix"), F.first("wide").alias("wide"), *more)


def needed(n_a: str, n_b: str, num: int, den: int) -> str:
    """SQL: the least overlap of sets of these sizes at a Jaccard similarity of num / den."""
    return f"(({num} * ({n_a} + {n_b}) + {num + den - 1}) div {num + den})"


def short(n: str, pos: str, num: int, den: int) -> str:
    """SQL: whether a place is in the short prefix of a set, which is enough against partners of at least its size:
    n - ceil(2t/(1+t) n) + 1 words."""
    return f"{pos} <= {n} - (({2 * num} * {n} + {num + den - 1}) div {num + den})"


_BAND = "cast(floor(log2(n)) as int)"
POSTED = ["rep", "n", "pos", "bitmap", "wide"]


def postings(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of the tiles: (tile, rep, n, pos, bitmap, wide).

    A tile is a prefix word and a band of sizes; bands double in size.  Members are posted in the band of
    their size, under their short prefix.  Visitors are posted under their whole prefix, also in the bands below
    in which a partner of t n words or more would lie.
    """
    rows = sets.select("rep", "n", "bitmap", "wide", F.posexplode("prefix").alias("pos", "word"))
    members = rows.where(short("n", "pos", num, den)).select(F.expr(f"hash(word, {_BAND})").alias("tile"), *POSTED)
    lowest = f"cast(floor(log2(greatest((n * {num} + {den - 1}) div {den}, 1))) as int)"
    visitors = rows.withColumn("band", F.explode(F.expr(f"sequence({lowest}, {_BAND})"))).select(F.expr("hash(word, band)").alias("tile"), *POSTED)
    return members, visitors


def may_overlap(num: int, den: int, a: str = "a", b: str = "b") -> str:
    """SQL condition on a (the smaller one) and b of one word: sizes, places and bit counts allow the similarity."""
    most = f"{a}.n + {b}.n - 2 * {needed(f'{a}.n', f'{b}.n', num, den)}"  # so many members may be in one of them only
    # written out, as a lambda would take the join out of generated code
    wide = " + ".join(f"bit_count({a}.wide[{i}] ^ {b}.wide[{i}])" for i in range(WIDE))
    return (
        f"({a}.n <= {b}.n and {b}.n * {num} <= {a}.n * {den} and bit_count({a}.bitmap ^ {b}.bitmap) <= {most}"
        f" and least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {needed(f'{a}.n', f'{b}.n', num, den)} and ({a}.wide is null or {b}.wide is null or {wide} <= {most}))"
    )
