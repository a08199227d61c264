"""Text cut off by field limits or in transfer.

Three kinds of evidence are added up as log odds for every content that does not end a sentence:

  word     The corpus vocabulary is kept as a trie: nodes of up to DEPTH letters, and under each full-depth node
           the words that go on.  A final token that is no known word but a proper prefix of known words is
           a cut word.
  length   Lengths at which a source has many more open-ended contents than at the lengths around are its limits.
  context  Tokens are mapped to common words, ID, NUM and signs.  For patterns over the last tokens (PATTERNS) the
           whole log tells how often they end a sentence or a content, and how often they go on.  The
           pattern that speaks most for an end decides: a cut text has none that does.

Vocabulary, limits and contexts are counted over the whole log, each distinct content once (for limits, once in a
source): copies of a text say nothing about it.  Only a short text that is a context by itself (WHOLE) is counted with its
copies, as its being written again and again is what tells that it is complete.  What is broadcast is the list of common words,
of which there are at most (words per row) / COMMON, and a bitmap of the codes of all ends, of CELLS_PER_CODE bits for each
distinct code and 16 MB at most.  Beyond that it lets more codes through to the shuffle; the join after it is on the codes.

Trie and length see words cut in two and cuts at a limit.  A text cut elsewhere between two words has neither, so these two
alone miss about a third of the cut texts of the test data, and the third kind decides there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import staged

#: A word is a common one if it is in COMMON_ROWS contents and this share of the distinct contents more.
COMMON, COMMON_ROWS = 0.0005, 5
#: Patterns over the tokens before an end: places counted from the end that must agree (others may be anything);
#: with True, the number of tokens since the sentence began must agree as well.
PATTERNS = [((1,), False), ((2, 1), False), ((2,), False), ((3, 1), False), ((3, 2), False), ((3, 2, 1), False), ((4, 3), False), ((4, 3, 1), False), ((2, 1), True)]
#: A text of at most so many tokens is a context by itself, word for word.
WHOLE = 4
#: A context counts if it was seen so often besides the content in question.
SEEN, SEEN_WHOLE = 6, 2
DEPTH = 6
#: A word counts as cut if words that go on from it are so many times as frequent.
FAR_RARER = 20
#: Size of the bitmap of wanted codes: bits for each, and powers of two they lie between.
CELLS_PER_CODE, LEAST_BITS, MOST_BITS, FLAT_BITS = 32, 16, 27, 24
#: Log odds of a cut before any evidence, and what single signs add.
PRIOR, CUT_WORD, OPEN_QUOTE, BROKEN = 0.3, 6.0, 2.0, 10.0
#: What counts where no context was seen often enough.
UNSEEN = -1.0
#: Bound on what the context adds or takes.
MOST = 5.0
#: The same for a length at a limit, and for one at a limit with dots at the end.
MOST_LIMIT, MOST_DOTTED = 2.0, 6.0
#: A limit is a length that comes this many times as often as the lengths around, and so often at least.
LIMIT_RATIO, LIMIT_ROWS, AROUND = 5.0, 6, 10

_WORD = re.compile(r"\w+")
_EDGE = re.compile(r"^\W+|\W+$")
_CLOSERS = ")]}>\"'”’»`*_"
_DOTS = re.compile(r"(?:…|\.\.\.+)$")
_BOS, _EOS, _ID, _NUM, _FIRST = 0, 1, 2, 3, 4


def _ending(token: str) -> int:
    """0: the token does not end a sentence; 1: it does; 2: it ends in dots."""
    core = token.rstrip(_CLOSERS)
    if not core:
        return 0
    return 2 if _DOTS.search(core) else 1 if core[-1] in ".!?" else 0


def _last_word(text: str) -> str:
    """The last word, however long, found from the end."""
    def is_word(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    end = len(text)
    while end and not is_word(text[end - 1]):
        end -= 1
    start = end
    while start and is_word(text[start - 1]):
        start -= 1
    found = _WORD.findall(text[start:end].lower())
    return found[-1] if found else ""


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, the number of contents that have them, and of those whose open end they are (not counted in the first)."""
    held: Counter = Counter()
    last: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = [*held, *(w for w in last if w not in held)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (held, last))], names=["word", "n", "n_last"])

    for b in batches:
        for text in b.column(0).to_pylist():
            found = _WORD.findall(text.lower())
            tokens = text.rsplit(None, 1)
            if found and tokens and _ending(tokens[-1]) != 1:
                last[found.pop()] += 1
            held.update(set(found))
        if len(held) > 400_000:
            yield out()
            held, last = Counter(), Counter()
    yield out()


class _Mapper:
    """Tokens to symbols, remembered for common tokens."""

    def __init__(self, common: dict[str, int]):
        self.common, self.known = common, {}

    def __call__(self, token: str) -> tuple[int, int, int]:
        got = self.known.get(token)
        if got is None:
            core = _EDGE.sub("", token).lower()
            raw = _FIRST + len(self.common) + zlib.crc32((core or token).encode())
            if not core:
                sym = raw
            elif core in self.common:
                sym = self.common[core]
            elif core.isdigit():
                sym = _NUM
            else:
                sym = _ID
            got = sym, _ending(token), raw
            if len(self.known) < 200_000:
                self.known[token] = got
        return got


def _symbols(texts: list[str], mapper: _Mapper) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, endings and plain words of all tokens, and the number of tokens of each text."""
    pairs: list[tuple[int, int, int]] = []
    n = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        tokens = text.split()
        n[i] = len(tokens)
        pairs += map(mapper, tokens)
    flat = np.array(pairs, np.int64).reshape(-1, 3)
    return flat[:, 0], flat[:, 1], flat[:, 2], n


def _codes(sym: np.ndarray, end: np.ndarray, raw: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each pattern the code of the context that ends at each token."""
    size = len(sym)
    before = np.where(end > 0, _EOS, sym)
    place = np.arange(size) - np.repeat(np.cumsum(n) - n, n)
    at = {1: sym}
    for k in (2, 3, 4):
        shifted = np.concatenate([np.zeros(min(k - 1, size), np.int64), before[: max(size - k + 1, 0)]])
        at[k] = np.where(place >= k - 1, shifted, _BOS)
    # tokens since the last end or the start
    starts = np.where((place == 0) | np.concatenate([[False], end[:-1] > 0]), np.arange(size), 0)
    since = np.arange(size) - np.maximum.accumulate(starts) if size else starts
    out = []
    with np.errstate(over="ignore"):
        for i, (places, counted) in enumerate(PATTERNS):
            code = np.full(size, i + 1, np.uint64)
            for part in [*(at[k] for k in places), *([since] if counted else [])]:
                code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(31)
            # two bits are left free for the kind; the lowest is 1 for texts that are a context by themselves
            out.append((code >> np.uint64(4)).astype(np.int64) * 2)
        code, whole = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        for k in range(min(WHOLE, size)):
            back = np.concatenate([np.zeros(k, np.int64), raw[: size - k]]).astype(np.uint64)
            code = (code ^ back) * np.uint64(0xD6E8FEB86659FD93)
            code ^= code >> np.uint64(32)
            whole = np.where(place == k, code, whole)
        out.append((whole >> np.uint64(4)).astype(np.int64) * 2 + 1)
    return out


class Wanted:
    """A bitmap over hashed codes."""

    def __init__(self, bits: int):
        self.bits, self.held, self.flat = bits, np.zeros(1 << (bits - 6), np.uint64), None

    def cells(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, code: np.ndarray) -> np.ndarray:
        cell = self.cells(code)
        if self.bits <= FLAT_BITS:  # a byte for each cell is faster to ask, once in each worker
            if self.flat is None:
                self.flat = np.unpackbits(self.held.view(np.uint8), bitorder="little").view(bool)
            return self.flat[cell]
        return (self.held[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _wanted(codes: DataFrame) -> Wanted:
    """The bitmap of the codes (a column code), sized by their number; the tasks send 64 cells in a row."""
    n = codes.agg(F.approx_count_distinct("code")).first()[0]
    wanted = Wanted(min(max((CELLS_PER_CODE * max(n, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS))
    empty = Wanted(wanted.bits)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(empty.held), np.uint64)
        for b in batches:
            cell = np.unique(empty.cells(np.asarray(b.column(0))))
            np.bitwise_or.at(held, cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].view(np.int64))], names=["at", "held"])

    table = codes.mapInArrow(partial, "at long, held long").groupBy("at").agg(F.bit_or("held").alias("held")).toArrow()
    wanted.held[np.asarray(table["at"])] = np.asarray(table["held"]).view(np.uint64)
    return wanted


def _tails(common):
    """(line_num, source, digest, length, word, open, broken, dots, codes) of the contents with an open end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = _Mapper(common.value)
        for b in batches:
            texts = b.column(2).to_pylist()
            rows, tails = [], []
            for i, text in enumerate(texts):
                tokens = text.rsplit(None, 6)
                end = _ending(tokens[-1]) if tokens else 1
                if end != 1:
                    rows.append(i)
                    # without its dots, the end is judged like any other
                    tails.append(_DOTS.sub("", text.rstrip().rstrip(_CLOSERS)) if end == 2 else text)
            if not rows:
                continue
            # over whole texts, as the contexts are counted
            sym, end, raw, n = _symbols(tails, mapper)
            n_safe = np.cumsum(n) - 1
            codes = _codes(sym, end, raw, n)
            some = n > 0
            at = np.where(some, n_safe, 0)
            lists = np.stack([c[at] if len(c) else np.zeros(len(at), np.int64) for c in codes], axis=1)
            stripped = [texts[i].rstrip() for i in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows)),
                    b.column(1).take(pa.array(rows)),
                    b.column(3).take(pa.array(rows)),
                    pa.array([len(s) for s in stripped], pa.int32()),
                    pa.array([_last_word(t) for t in tails], pa.string()),
                    pa.array([t.count("`") % 2 == 1 or t.count("(") > t.count(")") for t in tails]),
                    pa.array([s.endswith("�") for s in stripped]),
                    pa.array([s != t.rstrip() for s, t in zip(stripped, tails)]),
                    pa.array(list(lists), pa.list_(pa.int64())),
                ],
                names=["line_num", "source", "digest", "length", "word", "open", "broken", "dots", "codes"],
            ).filter(pa.array(some))

    return run


def _counts(common, wanted):
    """(code, ends, open_ends, goes_on) partial sums over whole contents (content, copies), for the contexts in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper, known = _Mapper(common.value), wanted.value.has
        for b in batches:
            sym, end, raw, n = _symbols(b.column(0).to_pylist(), mapper)
            if not len(sym):
                continue
            last = np.zeros(len(sym), bool)
            last[(np.cumsum(n) - 1)[n > 0]] = True
            kind = np.where(last & (end != 1), 1, np.where(end > 0, 0, 2))
            *codes, whole = _codes(sym, end, raw, n)
            found = [(c[keep] * 4 + kind[keep]) for c in codes if (keep := known(c)).any()]
            short = np.flatnonzero(whole > 1)
            short = short[known(whole[short])]
            if not found and not len(short):
                continue
            keys, m = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            more, place = np.unique(whole[short] * 4 + kind[short], return_inverse=True)
            copies = np.repeat(np.asarray(b.column(1)), n)[short]
            keys, m = np.concatenate([keys, more]), np.concatenate([m, np.bincount(place, copies, len(more)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 2), *(pa.array(np.where(keys & 3 == k, m, 0)) for k in range(3))], names=["code", "ends", "open_ends", "goes_on"])

    return run


def _trie(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n): every proper prefix of up to DEPTH letters and how often words go on from it; leaves (node, longer, n):
    longer words under their node."""
    nodes = vocabulary.select(F.explode(F.expr(f"transform(sequence(1, least(length(word) - 1, {DEPTH})), k -> substring(word, 1, k))")).alias("node"), "n")
    leaves = vocabulary.where(F.length("word") > DEPTH + 1).select(F.substring("word", 1, DEPTH).alias("node"), F.col("word").alias("longer"), "n")
    return nodes.groupBy("node").agg(F.sum("n").alias("n")), leaves


def _cut_words(tails: DataFrame, vocabulary: DataFrame, least: float) -> DataFrame:
    """(word) of the final words that are unknown, or rare beside the words that go on from them (FAR_RARER).  A word that
    is the open end of many contents is known."""
    nodes, leaves = _trie(vocabulary.where("n > 0 and length(word) > 1").select("word", "n"))
    ends = tails.where("word <> ''").select("word").distinct().join(vocabulary, "word", "left").where(f"coalesce(n_last, 0) < {least}")
    ends = staged(ends.select("word", F.coalesce("n", F.lit(0)).alias("own")), "ends")
    short = ends.where(F.length("word") <= DEPTH).join(nodes, F.col("word") == F.col("node"))
    long = ends.where(F.length("word") > DEPTH).withColumn("node", F.substring("word", 1, DEPTH))
    long = long.join(leaves, "node").where("startswith(longer, word) and longer <> word").groupBy("word", "own").agg(F.sum("n").alias("n"))
    return short.select("word", "own", "n").unionByName(long).where(f"n >= {FAR_RARER} * own").select("word")


def _limits(tails: DataFrame) -> DataFrame:
    """(source, length, ratio) of the lengths that are limits of a source."""
    by = tails.select("source", "length", "digest").distinct().groupBy("source", "length").agg(F.count("*").alias("rows"))
    near = Window.partitionBy("source").orderBy("length").rangeBetween(-AROUND, AROUND)
    ratio = by.withColumn("others", (F.sum("rows").over(near) - F.col("rows")) / F.lit(2.0 * AROUND))
    return ratio.withColumn("ratio", F.col("rows") / F.greatest("others", F.lit(0.5))).where(f"ratio >= {LIMIT_RATIO} and rows >= {LIMIT_ROWS}").select("source", "length", "ratio")


def scored(log: DataFrame) -> DataFrame:
    """(line_num, source, odds) of every content with an open end; odds above 0 mean it was cut off.

    Null and blank contents and contents that end a sentence are left out.
    """
    spark = log.sparkSession
    rows = log.select(F.col("line_num").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("content").cast("string")).where(r"line_num is not null and content rlike '\\S'")
    # combined before the shuffle, so a content of any number of copies moves once a partition
    texts = staged(rows.groupBy("content").agg(F.count("*").alias("copies")), "texts")
    vocabulary = staged(texts.mapInArrow(_vocabulary, "word string, n long, n_last long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_last").alias("n_last")), "vocabulary")
    least = COMMON_ROWS + COMMON * texts.count()
    frequent = vocabulary.where(F.col("n") >= least).orderBy(F.desc("n"), "word").select("word").toArrow()["word"].to_pylist()
    common = spark.sparkContext.broadcast({w: _FIRST + i for i, w in enumerate(frequent)})

    tails = staged(rows.withColumn("digest", F.xxhash64("content")).mapInArrow(_tails(common), "line_num long, source string, digest long, length int, word string, open boolean, broken boolean, dots boolean, codes array<long>"), "tails")
    wanted = spark.sparkContext.broadcast(_wanted(tails.select(F.explode("codes").alias("code"))))
    counts = texts.mapInArrow(_counts(common, wanted), "code long, ends long, open_ends long, goes_on long").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("ends", "open_ends", "goes_on")))

    contexts = (
        tails.select("line_num", F.explode("codes").alias("code"))
        .join(counts, "code")
        .where(f"code > 1 and ends + open_ends + goes_on > if(code & 1 = 1, {SEEN_WHOLE}, {SEEN})")
        .groupBy("line_num")
        .agg(F.min(F.expr("ln((goes_on + 0.5) / (ends + open_ends - 0.5))")).alias("weight"))
    )
    cut_words = _cut_words(tails, vocabulary, least).withColumn("cut_word", F.lit(True))
    out = (
        tails.join(contexts, "line_num", "left")
        .join(cut_words, "word", "left")
        .join(_limits(tails), ["source", "length"], "left")
    )
    odds = (
        f"{PRIOR} + least(greatest(coalesce(weight, {UNSEEN}), -{MOST}), {MOST}) + if(cut_word, {CUT_WORD}, 0) + if(open, {OPEN_QUOTE}, 0)"
        f" + if(broken, {BROKEN}, 0) + if(ratio is null, 0, least(ln(ratio), if(dots, {MOST_DOTTED}, {MOST_LIMIT})))"
    )
    return out.select("line_num", F.expr("nullif(source, '')").alias("source"), F.expr(odds).alias("odds"), "word", "cut_word", "ratio", "weight", "dots")


def found(log: DataFrame) -> DataFrame:
    """(line_num) of the contents that were cut off."""
    return scored(log).where("odds > 0").select("line_num").distinct()


def shares(log: DataFrame) -> DataFrame:
    """(source, n_rows, n_cut, cut_share) of each source over its non-null contents; null is a source of its own."""
    cut = found(log).withColumn("cut", F.lit(1))
    rows = log.select(F.col("line_num").cast("long"), F.col("source").cast("string"), "content").where("line_num is not null and content is not null").select("line_num", "source")
    return rows.join(cut, "line_num", "left").groupBy("source").agg(F.count("*").alias("n_rows"), F.count("cut").alias("n_cut"), F.avg(F.coalesce("cut", F.lit(0))).alias("cut_share"))
