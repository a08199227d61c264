"""Filling fixed-capacity containers with documents: large-item matching, then best fit of the small ones.

For a capacity C
  1. a document of more than C tokens is cut into pieces of C tokens and a rest; nothing else is ever split;
  2. items above C / 3, of which at most two share a container, are matched greedily: the largest
     unmatched item takes the largest other one that still fits beside it;
  3. the smaller items, largest first, go to the container with the smallest gap they fit in; where there is none a
     new container is opened.

Documents are dealt to shards by hash, each of about SHARD documents (a parameter), and a shard is packed by one
task; all that sharding costs is a few containers at the end of each shard.  Gaps and items are kept
by size, so a shard is packed in time linear in its items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, counted

SHARD = 20_000


class BySize:
    """Things kept by size; the nearest size is found by a bit mask."""

    def __init__(self):
        self.mask, self.held = 0, {}

    def put(self, size: int, thing) -> None:
        if size not in self.held:
            self.held[size] = []
            self.mask |= 1 << size
        self.held[size].append(thing)

    def take(self, size: int):
        things = self.held[size]
        thing = things.pop()
        if not things:
            del self.held[size]
            self.mask ^= 1 << size
        return thing

    def at_most(self, size: int) -> int | None:
        m = self.mask & ((1 << (size + 1)) - 1)
        return m.bit_length() - 1 if m else None

    def at_least(self, size: int) -> int | None:
        m = self.mask >> size
        return size + (m & -m).bit_length() - 1 if m else None


def pack(sizes: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Items (index, piece, first token, tokens) by container: returns [(container, index, piece, first, n)] as
    parallel tuples (container, index, piece, first, n), and the number of containers."""
    placed: list[tuple[int, int, int, int, int]] = []
    large, small, gaps = BySize(), [], BySize()
    containers = 0
    for i, size in enumerate(sizes):
        whole, rest = divmod(size, capacity)
        for p in range(whole):
            placed.append((containers, i, p, p * capacity, capacity))
            containers += 1
        if rest:
            item = (i, whole, whole * capacity, rest)
            if 3 * rest > capacity:
                large.put(rest, item)
            else:
                small.append(item)
    while large.mask:
        size = large.mask.bit_length() - 1
        placed.append((containers, *large.take(size)))
        gap = capacity - size
        partner = large.at_most(gap)
        if partner:
            placed.append((containers, *large.take(partner)))
            gap -= partner
        if gap:
            gaps.put(gap, containers)
        containers += 1
    small.sort(key=lambda item: -item[3])
    for item in small:
        gap = gaps.at_least(item[3])
        if gap is None:
            gap, at = capacity, containers
            containers += 1
        else:
            at = gaps.take(gap)
        placed.append((at, *item))
        if gap > item[3]:
            gaps.put(gap - item[3], at)
    return placed, containers


SCHEMA = "container_kind string, container_id long, doc_id long, piece int, first_token long, n_tokens long"


def containers(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """Where every token of every text goes, for each kind of container:
    (container_kind, container_id, doc_id, piece, first_token, n_tokens).

    Null and empty texts have no tokens and go nowhere; kinds without a positive capacity are left out.
    Kinds are a short list of settings, of which each name counts once (its largest capacity).
    """
    kinds = sorted((r[0], r[1]) for r in sizes.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens")).collect())
    shards = max(1, -(-documents.where("doc_id is not null and text <> ''").count() // shard))

    def run(table: pa.Table) -> pa.Table:
        docs, sizes = table.column("doc_id").to_pylist(), table.column("n_tokens").to_pylist()
        order = sorted(range(len(docs)), key=docs.__getitem__)
        docs, sizes = [docs[i] for i in order], [sizes[i] for i in order]
        base = table.column("shard")[0].as_py() << 32
        parts = []
        for kind, capacity in kinds:
            placed, _ = pack(sizes, capacity)
            at, i, piece, first, n = zip(*placed)
            parts.append(pa.table({
                "container_kind": pa.array([kind] * len(at), pa.string()), "container_id": pa.array([base + c for c in at], pa.int64()),
                "doc_id": pa.array([docs[x] for x in i], pa.int64()), "piece": pa.array(piece, pa.int32()),
                "first_token": pa.array(first, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
            }))
        return pa.concat_tables(parts)

    items = counted(documents, vocabulary=vocabulary).withColumn("shard", F.expr(f"pmod(xxhash64(doc_id), {shards})"))
    if not kinds:
        return items.sparkSession.createDataFrame([], SCHEMA)
    return items.groupBy("shard").applyInArrow(run, SCHEMA)


def fill(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, n_containers, n_tokens, fill) of each kind, fill being the used share of all space."""
    capacity = sizes.where("capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    used = containers(documents, sizes, vocabulary).groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"))
    by = used.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return by.join(capacity, "container_kind").select("container_kind", "n_containers", "n_tokens", F.expr("n_tokens / (n_containers * capacity)").alias("fill"))
