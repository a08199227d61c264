"""All similar pairs between set-valued records by pigeonhole partitioning.

For sets of length l and a Jaccard threshold t, two sets of which the longer has l members differ in at
most H(l) = floor(2 l (1-t)/(1+t)) members.  The token universe, in order frequent to rare, is dealt to m(l) segments
in turn, so that no segment gets more than its share of frequent tokens.

  allocation  Each segment of the longer set is filed whole (1 unit), whole and with each member deleted (2 units) or
              not at all.  With H + 1 units in sum, at least one filed segment differs by less than its units.  m(l) is one
              more than the least number, and the units go where the tokens tell most: empty segments and segments of
              frequent tokens alone are passed over.
  signatures  The shorter set probes with its own segments (against both kinds) and its one-deletion variants (against
              whole segments).
  rare tokens What a signature tells is the sum of log2(N / df) over its tokens.  Where that is less than log2 N (an empty key
              tells nothing), it is joined with the rarest tokens outside its segment: of two similar sets, the first d + c
              such tokens have c in common, if d is the most that either may lack.  So keys are never hot by chance.

Sizes and a 64-bit bitmap thin the matches out in the join, the rest is verified on the members.  Token counts are
kept in a table of a fixed number of hashed cells (CELLS); cells that share tokens make keys less telling, never wrong.
m above 8 is rounded up to a coarse grid, so that a probe meets few different m; more segments stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import expand, staged, tag_set
from tidemark.operators.signatures import needed

MIN_MEMBERS = 6
NUM, DEN = 6, 10
CELLS = 1 << 20
#: Parts of a bit in which tokens are weighed: whole numbers, so that sums are the same in any order.
UNIT = 16
#: A signature is joined with one rare token if it tells less than log2 N - SPARE bits, with two if less by TWO more.
SPARE, TWO = 2, 5
_MASK = (1 << 64) - 1


def _segments(length: int, num: int, den: int) -> int:
    """m(l) on the grid."""
    m = (2 * (den - num) * length) // (den + num) // 2 + 2
    if m <= 8:
        return m
    step = 1 << (m.bit_length() - 4)
    return -(-m // step) * step


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(44)).astype(np.int64)  # the upper 20 bits


def distinct_sets(rows: DataFrame, min_members: int) -> DataFrame:
    """(rep, members, n, items, hashes, bitmap), one row for each distinct set; rows: (id, items)."""
    sets = rows.where(F.size("items") >= min_members).groupBy("items").agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    bitmap = F.expr("aggregate(hashes, 0L, (a, x) -> a | shiftleft(1L, cast(x & 63 as int)))")
    return sets.withColumn("n", F.size("items")).withColumn("hashes", F.expr("transform(items, x -> xxhash64(x))")).withColumn("bitmap", bitmap)


def _token_counts(sets: DataFrame) -> np.ndarray:
    """How many distinct sets have a token of each cell; the tasks send partial sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            total += np.bincount(_cell(np.asarray(b.column(0).flatten())), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    table = sets.select("hashes").mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    out = np.zeros(CELLS, np.int64)
    out[np.asarray(table["cell"])] = np.asarray(table["n"])
    return out


def _allocated(costs: list[tuple[float, float]], need: int) -> list[int]:
    """Units of each segment (0, 1 or 2) with `need` in sum at the least cost; costs: of one unit and of two."""
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for one, two in costs:
        after: dict[int, tuple[float, tuple]] = {}
        for units, (cost, taken) in best.items():
            for k, more in ((0, 0.0), (1, one), (2, two)):
                at = min(need, units + k)
                if at not in after or cost + more < after[at][0]:
                    after[at] = (cost + more, (*taken, k))
        best = after
    return list(best[need][1])


def signatures(counts, total: int, filing: bool, least: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (rep, bitmap, hashes): (key, rep, n, bitmap, part) of the sets as the longer ones, to be filed, or as
    the shorter ones that probe.  part: filed whole only, or a probe of a deletion; the two do not meet."""
    enough = int(UNIT * (np.log2(max(total, 1)) - SPARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = counts.value
        place = np.empty(CELLS, np.int64)
        place[np.lexsort((np.arange(CELLS), -df))] = np.arange(CELLS)
        tells = np.round(UNIT * np.log2(total / np.maximum(df, 1))).astype(np.int64)
        for b in batches:
            sums: list[int] = []
            rare: list[int] = []
            tags: list[int] = []
            part: list[bool] = []
            made = []
            at = np.asarray(b.column(2).offsets)
            flat = np.asarray(b.column(2).values)[at[0] : at[-1]]
            at = at - at[0]
            cells = _cell(flat)
            places, bits, hashes = place[cells], tells[cells], flat.view(np.uint64)
            for r in range(b.num_rows):
                s = slice(at[r], at[r + 1])
                members = sorted(zip((-places[s]).tolist(), hashes[s].tolist(), bits[s].tolist()))  # rare first
                length = len(members)
                before = len(sums)
                if filing:
                    shortest = max(least, -(-num * length // den))
                    lacks = length - -(-num * (shortest + length) // (num + den))
                    ms = [_segments(length, num, den)]
                else:
                    lacks = length - -(-2 * num * length // (num + den))
                    ms = sorted({_segments(x, num, den) for x in range(length, length * den // num + 1)})
                for m in ms:
                    parts: list[list] = [[] for _ in range(m)]
                    for p, h, bit in members:
                        parts[-p % m].append((h, bit))
                    units = None
                    if filing:
                        costs = []
                        for p in parts:
                            whole = 2.0 ** (-sum(bit for _, bit in p) / UNIT)
                            costs.append((total * whole + 0.01, total * (12 * whole + sum(whole * 2.0 ** (bit / UNIT) for _, bit in p)) + 0.01 * (1 + len(p))))
                        units = _allocated(costs, 2 * (den - num) * length // (den + num) + 1)
                    for i, p in enumerate(parts):
                        if units and not units[i]:
                            continue
                        whole, told = sum(h for h, _ in p), sum(bit for _, bit in p)
                        # (kind, sum of hashes, bits told, part)
                        keys = [(0, whole, told, units[i] == 1)] if units else [(0, whole, told, False), (1, whole, told, False)]
                        if not units or units[i] == 2:
                            keys += [(int(filing), whole - h, told - bit, not filing) for h, bit in p]
                        outside = [h * 0x9E3779B97F4A7C15 & _MASK for q, h, _ in members if -q % m != i]
                        sure = max(len(outside) - lacks, 0)  # so many of them any similar set has
                        for kind, content, told, flag in keys:
                            most = 0 if told >= enough else 1 if told >= enough - UNIT * TWO else 2
                            for c in range(most, min(most, sure) - 1, -1):
                                tag = (m << 24 | i << 4 | kind << 3 | c) & _MASK
                                first = outside[: lacks + c]
                                joined = [0] if not c else first if c == 1 else [x + y for x, y in combinations(first, 2)]
                                sums += [content & _MASK] * len(joined)
                                rare += [x & _MASK for x in joined]
                                tags += [tag] * len(joined)
                                part += [flag] * len(joined)
                made.append(len(sums) - before)
            times = np.array(made, np.int64)
            with np.errstate(over="ignore"):
                key = np.array(sums, np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.array(tags, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) + np.array(rare, np.uint64)
                key = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
            row = pa.array(np.repeat(np.arange(b.num_rows), times))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), b.column(0).take(row), pa.array(np.repeat(np.diff(at), times).astype(np.int32)), b.column(1).take(row), pa.array(part, pa.bool_())],
                names=["key", "rep", "n", "bitmap", "part"],
            )

    return run


def candidates(sets: DataFrame, min_members: int, num: int, den: int) -> DataFrame:
    """(rep_a, rep_b) of the distinct sets that share a signature and may be similar by size and bitmap."""
    counts = _token_counts(sets)
    total = sets.count()
    shared = sets.sparkSession.sparkContext.broadcast(counts.astype(np.int32))
    slim, made = sets.select("rep", "bitmap", "hashes"), "key long, rep long, n int, bitmap long, part boolean"
    probing = slim.mapInArrow(signatures(shared, total, False, min_members, num, den), made)
    filed = slim.mapInArrow(signatures(shared, total, True, min_members, num, den), made)
    need = needed("a.n", "b.n", num, den)
    met = probing.alias("a").join(filed.alias("b"), F.expr(
        f"a.key = b.key and a.n <= b.n and b.n * {num} <= a.n * {den} and (a.n < b.n or a.rep < b.rep)"
        f" and not (a.part and b.part) and bit_count(a.bitmap ^ b.bitmap) <= a.n + b.n - 2 * {need}"))
    return met.select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).distinct()


def similar_sets(rows: DataFrame, min_members: int = MIN_MEMBERS, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """rows: (id, items array<string>, sorted and distinct).  Returns members (id, rep, members) and
    links (rep_a, rep_b) between different sets.  Null ids and short sets take no part."""
    rows = staged(rows.select("id", "items").where(F.col("id").isNotNull() & (F.size("items") >= min_members)).distinct(), "item-sets")
    sets = staged(distinct_sets(rows, min_members), "distinct-sets")
    pairs = candidates(sets, min_members, num, den)
    a = sets.select(F.col("rep").alias("rep_a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("rep").alias("rep_b"), F.col("items").alias("items_b"))
    checked = pairs.join(a, "rep_a").join(b, "rep_b").where(F.expr(f"size(array_intersect(items_a, items_b)) >= {needed('size(items_a)', 'size(items_b)', num, den)}"))
    links = staged(checked.select("rep_a", "rep_b"), "set-links")
    members = rows.join(sets.select("items", "rep", "members"), "items").select("id", "rep", "members")
    return members, links


def tagged(log: DataFrame, core: DataFrame) -> DataFrame:
    """(id, items) of both tables: the tag sets as sorted letter keys."""
    a = log.select(F.col("line_num").cast("long").alias("id"), tag_set(F.col("tags")).alias("items"))
    b = core.select(F.col("core_id").cast("long").alias("id"), tag_set(F.col("tags")).alias("items"))
    return a.unionByName(b)


def found(log: DataFrame, core: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of entries with largely the same tags."""
    return expand(*similar_sets(tagged(log, core)))


def linked(log: DataFrame, core: DataFrame) -> DataFrame:
    """One row for each entry with enough tags: (id, class_id, class_size, n_links)."""
    members, links = similar_sets(tagged(log, core))
    degree = links.selectExpr("explode(array(rep_a, rep_b)) as rep").groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(degree, "rep", "left").select("id", F.col("rep").alias("class_id"), F.col("members").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
