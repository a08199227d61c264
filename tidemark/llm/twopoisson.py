"""How distinctive a term is in a record: a two-Poisson mixture for each term.

A term occurs in records either in passing (Poisson rate low) or because the record is about it (the
elite component, rate high).  For each term the mixture (share of elite records, two rates) is fitted by
expectation-maximisation on the term's frequency histogram over the whole collection, records without
the term included.  An occurrence count k then scores

    score = P(elite | k) * ln(1 + N / df)

so that common terms count little and rare repeated ones much.  Histograms are summed inside the
tasks before anything is shuffled, and each distinct histogram of a batch is fitted once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


MIN_TERM = 3
#: Rounds of EM at most; a mixture of which no parameter moves by more than CLOSE of itself stays as it is.
ITERATIONS, CLOSE = 200, 1e-6
#: Partial histograms a task holds before it hands them on.
HELD = 400_000

_WORD = re.compile(r"\w+")


def _terms(text: str) -> Counter:
    return Counter(w for w in _WORD.findall(text.lower()) if len(w) >= MIN_TERM)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["term", "k", "n"]

    def out(held: dict) -> pa.RecordBatch:
        terms, ks = zip(*held) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ks, pa.int32()), pa.array(list(held.values()), pa.int64())], names=names)

    held: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                held.update(_terms(text).items())
        if len(held) > HELD:
            yield out(held)
            held = Counter()
    yield out(held)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, terms, ks = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                c = _terms(text)
                ids += [i] * len(c)
                terms += c.keys()
                ks += c.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(ks, pa.int32())], names=["id", "term", "k"])


def fit(k: np.ndarray, n: np.ndarray, start: np.ndarray, total: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixtures of many histograms at once.

    k, n: counts and how many records have them, histogram after histogram; start: where each begins.
    Returns the elite share, the low rate and the high rate of each; none depends on which others are fitted with it.
    """
    k = k.astype(float)
    n = n.astype(float)
    owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
    df = np.add.reduceat(n, start)
    zero = np.maximum(total - df, 0.0)
    mass = np.add.reduceat(n * k, start)
    # elite at first: counts above the mean of the records that have the term
    mean = mass / df
    high = np.maximum(np.maximum.reduceat(k, start), mean + 1.0)
    low = np.maximum(mass / total * 0.5, 1e-9)
    share = np.clip(0.1 * df / total, 1e-12, 0.5)
    moving = np.ones(len(start), bool)
    for _ in range(iterations):
        odds = np.log(share / (1 - share)) - (high - low)
        elite = 1 / (1 + np.exp(-np.clip(odds[owner] + k * np.log(high / low)[owner], -700, 700)))
        elite0 = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        weight = np.add.reduceat(n * elite, start) + zero * elite0
        told = np.add.reduceat(n * elite * k, start)
        new_low = np.maximum((mass - told) / np.maximum(total - weight, 1e-300), 1e-9)
        new = np.clip(weight / total, 1e-12, 0.5), new_low, np.maximum(np.maximum(told / np.maximum(weight, 1e-300), 1e-6), new_low * 1.0001)
        still = moving & np.any([np.abs(x - y) > CLOSE * np.abs(y) for x, y in zip(new, (share, low, high))], axis=0)
        share, low, high = (np.where(moving, x, y) for x, y in zip(new, (share, low, high)))
        moving = still
        if not moving.any():
            break
    return share, low, high


def _fitter(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, hists = b.column(0), b.column(1)
            kinds: dict[bytes, int] = {}
            which = np.empty(len(terms), np.int64)
            parts = []
            values = hists.values
            at = np.asarray(hists.offsets)
            ks, ns = np.asarray(values.field(0)), np.asarray(values.field(1))
            for i in range(len(terms)):
                pair = np.stack([ks[at[i] : at[i + 1]].astype(np.int64), ns[at[i] : at[i + 1]]])
                name = pair.tobytes()
                if name not in kinds:
                    kinds[name] = len(parts)
                    parts.append(pair)
                which[i] = kinds[name]
            if not parts:
                continue
            start = np.concatenate([[0], np.cumsum([p.shape[1] for p in parts])[:-1]]).astype(np.int64)
            flat = np.concatenate(parts, axis=1)
            share, low, high = fit(flat[0], flat[1], start, total)
            df = np.add.reduceat(flat[1], start)
            yield pa.RecordBatch.from_arrays(
                [terms, *(pa.array(x[which]) for x in (df, share, low, high))], names=["term", "df", "share", "low", "high"]
            )

    return run


def models(rows: DataFrame) -> DataFrame:
    """(term, df, share, low, high) of every term; rows: (id, content).

    Null and empty contents have no terms and count as records without any."""
    total = max(rows.count(), 1)
    summed = (
        rows.select(F.col("content").cast("string"))
        .mapInArrow(_histograms, "term string, k int, n long")
        .repartition("term")
        .groupBy("term", "k")
        .agg(F.sum("n").alias("n"))
        .groupBy("term")
        .agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("hist"))
    )
    return summed.mapInArrow(_fitter(total), "term string, df long, share double, low double, high double").withColumn("total", F.lit(total))


ELITE = "1 / (1 + exp(ln((1 - share) / share) + (high - low) - k * ln(high / low)))"


def scores(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, term, k, df, elite, score) of the terms of the rows `of` (all rows where not given), the models
    being those of all rows."""
    of = rows if of is None else of
    used = of.select(F.col("id").cast("long"), F.col("content").cast("string")).where("id is not null and content is not null").mapInArrow(_occurrences, "id long, term string, k int")
    return used.join(models(rows), "term").withColumn("elite", F.expr(ELITE)).select("id", "term", "k", "df", "elite", F.expr("elite * ln(1 + total / df)").alias("score"))


def log_rows(log: DataFrame) -> DataFrame:
    return log.select(F.col("line_num").alias("id"), "content")


def found(log: DataFrame) -> DataFrame:
    """(line_num, term): the term that marks each SESSION_CHECKPOINT row most, among those also used in
    other rows; ties go to the more frequent one, then by name.  A row without such a term is left out."""
    points = log.where(r"upper(regexp_replace(type, '^\\s+|\\s+$', '')) = 'SESSION_CHECKPOINT'")
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("k"), "term")
    ranked = scores(log_rows(log), log_rows(points)).where("df > 1").withColumn("place", F.row_number().over(best))
    return ranked.where("place = 1").select(F.col("id").alias("line_num"), "term")


def beside_stale(log: DataFrame, weights: DataFrame, cache: DataFrame) -> DataFrame:
    """Every term of every row with its score, the weight an older snapshot gives it (null where it has none), and whether
    the derived cache (line_num, tokens) has it among the row's tokens (null where the cache lacks the row):
    (line_num, term, k, score, stale_weight, cached)."""
    old = weights.select(F.col("token").alias("term"), F.col("weight").cast("double").alias("stale_weight")).where("term is not null").groupBy("term").agg(F.max("stale_weight").alias("stale_weight"))
    held = cache.where("line_num is not null and tokens is not null").groupBy("line_num").agg(F.max("tokens").alias("tokens"))
    scored = scores(log_rows(log)).join(old, "term", "left").select(F.col("id").alias("line_num"), "term", "k", "score", "stale_weight")
    return scored.join(held, "line_num", "left").select("line_num", "term", "k", "score", "stale_weight", F.expr("array_contains(split(tokens, ' +'), term)").alias("cached"))
