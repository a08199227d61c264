"""The best entries of each query, from postings packed by age.

Entries lie in parts of about PART rows, the youngest first, each with its postings as sorted places.  A task takes queries and goes
through the parts block by block.  What an entry of a block can still score is bounded by its age and by the evidence
it could have, so blocks, and entries with common words alone, are passed over as soon as they cannot reach the k best found.
Bounds only pass over what cannot be among the results: these are those of `score.scored` on all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.fixed import PRIORITY_TYPES

PART, PIECE = 1 << 16, 4_000
#: The first blocks of a part are small, so that the bound is known early.
BLOCKS = (0, 1 << 11, 1 << 13, 1 << 15, 1 << 31)
#: Scores are rounded to six places.
SLACK = 2e-6
PACKED = """entry_id array<long>, age_days array<double>, priority array<int>, dear array<boolean>, n_tokens array<int>,
  words array<string>, ends array<int>, places array<int>, tag_words array<string>, tag_ends array<int>, tag_places array<int>"""
FOUND = "query_id long, entry_id long, match double, n_exact int, score double, rank int"
BEST = [("entry_id", np.int64), ("match", np.float64), ("n_exact", np.int32), ("score", np.float64)]
NONE = np.empty(0, np.int32)


def _postings(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, ends of their places, and places, ascending for each word."""
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists), dtype=np.int32), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return coded.dictionary, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))).astype(np.int32), rows[np.argsort(codes, kind="stable")]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if sum(b.num_rows for b in held):
        rows = pa.Table.from_batches(held).combine_chunks()
        columns = [rows[c].combine_chunks() for c in ("entry_id", "age_days", "priority", "dear", "n_tokens")]
        for c in ("tokens", "tag_tokens"):
            columns += _postings(rows[c].combine_chunks())
        columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PACKED.split(",")])


def pack(entries: DataFrame, folder: str) -> None:
    """entries: (entry_id, age_days, priority, kind, tokens, tag_tokens), those past the quality gate."""
    dear = F.coalesce(F.lower(T.text(F.col("kind"))).isin(list(PRIORITY_TYPES)), F.lit(False))
    rows = entries.select("entry_id", "age_days", F.col("priority").cast("int").alias("priority"), dear.alias("dear"), F.size("tokens").alias("n_tokens"), "tokens", "tag_tokens")
    parts = max(1, -(-entries.count() // PART))
    rows.repartitionByRange(parts, "age_days", "entry_id").sortWithinPartitions("age_days", "entry_id").mapInArrow(_pack, PACKED).write.mode("overwrite").parquet(folder)


class Part:
    def __init__(self, row: pa.Table):
        self.entry_id, self.age, self.priority, self.dear, self.n_tokens, self.words, ends, self.places, self.tag_words, tag_ends, self.tag_places = (
            c.chunk(0).flatten() if k in (5, 8) else c.chunk(0).flatten().to_numpy(zero_copy_only=False) for k, c in enumerate(row.columns)
        )
        self.starts, self.tag_starts = np.append(0, ends), np.append(0, tag_ends)
        self.most = 1 + 0.1 * max(0, int(self.priority.max()))
        self.flag = np.zeros(len(self.entry_id), bool)

    def look_up(self, words: pa.Array) -> None:
        """The postings of the words of a piece of queries, by their place in it."""
        self.code, self.tag_code = (pc.fill_null(pc.index_in(words, value_set=w), -1).to_numpy(zero_copy_only=False) for w in (self.words, self.tag_words))

    def of(self, words: list[int]) -> np.ndarray:
        lists = [self.places[self.starts[c] : self.starts[c + 1]] for c in (self.code[w] for w in words) if c >= 0]
        return NONE if not lists else lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))

    def tagged(self, word: int) -> np.ndarray:
        c = self.tag_code[word]
        return self.tag_places[self.tag_starts[c] : self.tag_starts[c + 1]] if c >= 0 else NONE

    def inside(self, cand: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which of the candidates are among the places; both ascend."""
        if len(places) > 8 * len(cand):
            at = np.minimum(np.searchsorted(places, cand), len(places) - 1)
            return places[at] == cand
        self.flag[places] = True
        out = self.flag[cand]
        self.flag[places] = False
        return out


def _cut(places: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return places[np.searchsorted(places, lo) : np.searchsorted(places, hi)] if len(places) else places


class Query:
    """A query: its tokens by groups of one stem, and the best entries so far."""

    def __init__(self, query_id: int, tokens: list[dict], number, k: int, least: float, only_exact: bool, cached: bool):
        self.query_id, self.k, self.cached, self.n = query_id, k, cached, len(tokens)
        own, groups = {t["token"] for t in tokens}, {}
        self.total = sum(t["weight"] for t in sorted(tokens, key=lambda t: t["token"]))
        for t in sorted(tokens, key=lambda t: t["token"]):
            g = groups.setdefault(t["stem"], (t["stem_weight"], [] if only_exact else [number(w) for w in t["family"] or ()], []))
            others = [] if only_exact else [number(w) for w in t["others"] or () if w not in own]
            g[2].append((t["weight"], number(t["token"]), [number(w) for w in t["aliases"] or ()], others))
        self.groups = list(groups.values())
        self.bound, self.rows = least, np.empty(0, BEST)

    def reach(self, match: float, boost: float) -> float:
        """No pair with this match scores more, but for priority and age."""
        return match * boost if self.n >= 3 and match > 0.15 - 1e-6 else match

    def meet(self, part: Part, rate: float) -> None:
        keys = []
        for stem_weight, family, tokens in self.groups:
            lists = [(w, part.of([x]), part.of(a), part.of(p), part.tagged(x)) for w, x, a, p in tokens]
            stems = part.of(family)
            weight, exact = sum(t[0] for t in tokens), any(len(x) or len(a) for _, x, a, _, _ in lists)
            most = max(weight if exact else 0.5 * weight, (0.7 * stem_weight if len(stems) else 0) + 0.25 * weight)
            if exact or len(stems) or any(len(p) for _, _, _, p, _ in lists):
                keys.append((most, any(len(x[4]) for x in lists), stem_weight, stems, lists))
        keys.sort(key=lambda x: -x[0])
        # the most that evidence from each key on can give
        reach, upto, boost = [], 0.0, 1.5
        for most, tagged, *_ in reversed(keys):
            upto, boost = upto + most, 3.0 if tagged else boost
            reach.append(self.reach(upto / self.total * (1 + 1e-9), boost) * part.most)
        reach.reverse()
        for lo, hi in zip(BLOCKS, BLOCKS[1:]):
            hi = min(hi, len(part.age))
            if lo >= hi or not keys:
                break
            decay = math.exp(-rate * part.age[lo])
            need = next((i for i, r in enumerate(reach) if r * decay < self.bound - SLACK), len(keys))
            if need == 0:
                break
            if self.bound > SLACK and reach[0] * math.exp(-rate * part.age[hi - 1]) < self.bound - SLACK:
                oldest = math.log(reach[0] / (self.bound - SLACK)) / rate
                hi = int(np.searchsorted(part.age, oldest + 1e-6, "right"))
            self.block(part, keys, need, lo, hi, rate)

    def block(self, part: Part, keys: list, need: int, lo: int, hi: int, rate: float) -> None:
        keys = [(sw, _cut(s, lo, hi), [(w, *(_cut(p, lo, hi) for p in lists)) for w, *lists in tokens]) for _, _, sw, s, tokens in keys]
        for _, stems, tokens in keys[:need]:
            for places in (stems, *(p for t in tokens for p in t[1:4])):
                part.flag[places] = True
        cand = (np.flatnonzero(part.flag[lo:hi]) + lo).astype(np.int32)
        part.flag[lo:hi] = False
        if not len(cand):
            return
        exact_w, stem_w, only_w, part_w = np.zeros((4, len(cand)))
        n_exact, direct, n_stem = np.zeros((3, len(cand)), np.int32)
        overlap = np.zeros(len(cand), bool)
        for stem_weight, stems, tokens in keys:
            any_exact = None
            for w, x, a, p, tag in tokens:
                exact = None
                if len(x):
                    exact = part.inside(cand, x)
                    direct += exact
                if len(a):
                    by_alias = part.inside(cand, a)
                    exact = by_alias if exact is None else exact | by_alias
                if exact is not None:
                    exact_w += w * exact
                    n_exact += exact
                    any_exact = exact if any_exact is None else any_exact | exact
                if len(p):
                    held = part.inside(cand, p)
                    part_w += w * (held if exact is None else held & ~exact)
                if len(tag):
                    overlap |= part.inside(cand, tag)
            if len(stems):
                has = part.inside(cand, stems)
                stem_w += stem_weight * has
                n_stem += has
                only_w += stem_weight * (has if any_exact is None else has & ~any_exact)
        match = np.where(n_exact > 0, exact_w + 0.7 * only_w + 0.25 * part_w, np.where(n_stem > 0, 0.7 * stem_w, 0.5 * part_w)) / self.total
        near = np.round(match, 9)
        strong = ((near >= 0.3) | ((near >= 0.15) & (n_exact > 0))) & (self.n >= 3)
        n_tokens = part.n_tokens[cand]
        cover = np.where((n_exact > 0) & (n_tokens > 3), np.clip(3 * direct / np.sqrt(n_tokens), 0.15, 1.0), 1.0)
        boost = np.where(strong, np.where(overlap, 2.0, 1.0) * np.where(part.dear[cand], 1.5, 1.0), 1.0)
        score = np.round(match * boost * (1 + 0.1 * part.priority[cand]) * np.exp(-rate * part.age[cand]) * cover, 6)
        keep = (score > 0) & (score >= self.bound)
        if self.cached:
            keep &= (n_exact > 0) | (n_stem > 0)
        keep = np.flatnonzero(keep)
        self.add(part.entry_id[cand[keep]], np.round(match[keep], 6), n_exact[keep], score[keep])

    def add(self, entry_id, match, n_exact, score) -> None:
        new = np.empty(len(score), BEST)
        new["entry_id"], new["match"], new["n_exact"], new["score"] = entry_id, match, n_exact, score
        self.rows = np.concatenate([self.rows, new])
        self.rows = self.rows[np.lexsort((self.rows["entry_id"], -self.rows["score"]))[: self.k]]
        if len(self.rows) == self.k:
            self.bound = max(self.bound, float(self.rows["score"][-1]))


def searcher(folder: str, k: int, rate: float, least: float, only_exact: bool, cached: bool):
    """For mapInArrow: FOUND of queries (query_id, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pyarrow.fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(where)) if f.path.endswith(".parquet") and f.base_name[0] not in "._")
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                yield piece(fs, files, batch.slice(start, PIECE))

    def piece(fs, files: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
        words: dict[str, int] = {}
        asked = [Query(i, tokens, lambda w: words.setdefault(w, len(words)), k, least, only_exact, cached) for i, tokens in zip(batch["query_id"].to_pylist(), batch["tokens"].to_pylist())]
        names = pa.array(words, pa.string())
        for path in files:
            row = pq.read_table(path, filesystem=fs)
            if not row.num_rows:
                continue
            part = Part(row)
            part.look_up(names)
            for q in asked:
                q.meet(part, rate)
        hits = [q for q in asked if len(q.rows)]
        rows = np.concatenate([q.rows for q in hits]) if hits else np.empty(0, BEST)
        ids = np.repeat(np.array([q.query_id for q in hits], np.int64), [len(q.rows) for q in hits]) if hits else np.empty(0, np.int64)
        ranks = np.concatenate([np.arange(1, len(q.rows) + 1) for q in hits]).astype(np.int32) if hits else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *(np.ascontiguousarray(rows[c]) for c, _ in BEST), ranks)], [f.split()[0] for f in FOUND.split(", ")])

    return run
