"""Exact and near duplicates, and the three-way decision SKIP / SUPERSEDE / APPEND."""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions import text as T
from tidemark.operators import signatures
from tidemark.operators.order import positions
from tidemark.operators.staging import staged


def hash_duplicates(log: DataFrame) -> DataFrame:
    """(line_num, first_line) of the rows whose lower-cased content came before.  Null contents are no duplicates.

    Groups are reduced to their first row by a map-side combined aggregation before they are joined.
    """
    hashed = log.where("line_num is not null and content is not null").select("line_num", T.content_hash(F.col("content")).alias("hash"))
    firsts = hashed.groupBy("hash").agg(F.min("line_num").alias("first_line"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(firsts, "hash").where("line_num > first_line").select("line_num", "first_line")


_WORD = re.compile(r"\w+")


class Tail:
    """The last entries of a log (line, bytes, length, start, words), newest first within the limits of bytes and rows."""

    def __init__(self, config: EngineConfig):
        self.config, self.held = config, deque(maxlen=config.tail_rows + 1)

    def add(self, line: int, size: int, length: int, start: str, words: frozenset) -> None:
        self.held.append([line, size, length, start, words])

    def compare(self, length: int, start: str, words: frozenset) -> tuple[bool, list | None]:
        """Whether an entry is the same as one of the last ones, else the entry it supersedes."""
        c, used, target = self.config, 0, None
        for k, old in enumerate(reversed(self.held)):
            used += old[1]
            if used >= c.tail_bytes:
                break
            common = len(words & old[4])
            total = len(words) + len(old[4]) - common
            if k < c.tail_rows and (start == old[3] or common > c.duplicate * total):
                return True, None
            if target is None and common and c.supersede_from * total <= common <= c.duplicate * total and length >= old[2]:
                target = old
        return False, target


#: Positions of the log that one task decides in order, after a look at the tail of those before.
BLOCK = 1 << 14


def tail_decisions(log: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(line_num, decision, target): what would become of each row, were it appended to the log of the rows before it.

    SKIP if it has the hash of any earlier row, or the first 80 characters, or more than `duplicate` of the words, of one
    of the last `tail_rows` rows; else SUPERSEDE the latest of the last tail_rows + 1 rows with a similarity from
    supersede_from to duplicate that is not longer; else APPEND.  The tail is at most tail_bytes bytes of content
    long.  Empty contents are always appended.

    The log is cut into blocks of positions; each gets the tail of the block before along, and passes once by a ring of the
    last rows.  So a row moves about once, not once for each row of its tail.
    """
    rows = log.where("line_num is not null").select("line_num", T.text(F.col("content")).alias("content"))
    rows = rows.select("line_num", (F.octet_length("content") + 1).alias("bytes"), F.length("content").alias("length"), F.lower("content").alias("lower"), F.lower(F.substring("content", 1, 80)).alias("start"))
    width = config.tail_rows + 1
    blocks = F.expr(f"if(pos % {BLOCK} >= {BLOCK - width}, array(pos div {BLOCK}, pos div {BLOCK} + 1), array(pos div {BLOCK}))")
    placed = positions(rows, "line_num").select("*", F.explode(blocks).alias("block"))

    def decide(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        block = part["block"][0].as_py()
        tail, out = Tail(config), ([], [], [])
        columns = (part[c].to_pylist() for c in ("pos", "line_num", "bytes", "length", "start", "lower"))
        for pos, line, size, length, start, lower in zip(*columns):
            words = frozenset(_WORD.findall(lower))
            if pos // BLOCK == block:
                same, target = tail.compare(length, start, words) if length else (False, None)
                for values, v in zip(out, (line, same, target and target[0])):
                    values.append(v)
            tail.add(line, size, length, start, words)
        return pa.table({"line_num": pa.array(out[0], pa.int64()), "same": pa.array(out[1], pa.bool_()), "target": pa.array(out[2], pa.int64())})

    best = placed.groupBy("block").applyInArrow(decide, "line_num long, same boolean, target long")
    hashed = hash_duplicates(log).select("line_num", F.lit(True).alias("hashed"))
    out = rows.select("line_num", "length").join(best, "line_num").join(hashed, "line_num", "left")
    decision = F.expr("case when length = 0 then 'APPEND' when hashed or same then 'SKIP' when target is not null then 'SUPERSEDE' else 'APPEND' end")
    return out.withColumn("decision", decision).select("line_num", "decision", F.expr("if(decision = 'SUPERSEDE', target, null)").alias("target"))


def snapshot_decisions(new: DataFrame, log: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(id, decision, target) of new entries (id, content), each against the log as it stands: the same rules."""
    stored = log.where("line_num is not null").select("line_num", T.text(F.col("content")).alias("content"))
    # at most tail_rows + 1 rows, so one array
    last = stored.orderBy(F.desc("line_num")).limit(config.tail_rows + 1).withColumn("k", F.row_number().over(Window.orderBy(F.desc("line_num"))))
    last = last.withColumn("upto", F.sum(F.octet_length("content") + 1).over(Window.orderBy("k"))).where(F.col("upto") < config.tail_bytes)
    item = F.struct("k", "line_num", F.length("content").alias("length"), T.word_set(F.col("content")).alias("words"), F.lower(F.substring("content", 1, 80)).alias("start"))
    tail = last.agg(F.array_sort(F.collect_list(item)).alias("tail"))
    rows = new.where("id is not null").select("id", T.text(F.col("content")).alias("content"))
    rows = rows.select("id", F.length("content").alias("length"), F.lower(F.substring("content", 1, 80)).alias("start"), T.word_set(F.col("content")).alias("words"), T.content_hash(F.col("content")).alias("hash"))
    rows = rows.withColumn("tail", tail.select("tail").scalar())
    common, total = "size(array_intersect(words, o.words))", "size(array_union(words, o.words))"
    rows = rows.withColumn("same", F.expr(f"exists(tail, o -> o.k <= {config.tail_rows} and (start = o.start or {common} > {config.duplicate}D * {total}))"))
    middle = f"{common} > 0 and {common} >= {config.supersede_from}D * {total} and {common} <= {config.duplicate}D * {total} and length >= o.length"
    rows = rows.withColumn("target", F.expr(f"get(filter(tail, o -> {middle}), 0).line_num"))
    known = stored.where("content <> ''").select(T.content_hash(F.col("content")).alias("hash")).distinct().withColumn("hashed", F.lit(True))
    decision = F.expr("case when length = 0 then 'APPEND' when hashed or same then 'SKIP' when target is not null then 'SUPERSEDE' else 'APPEND' end")
    return rows.join(known, "hash", "left").withColumn("decision", decision).select("id", "decision", F.expr("if(decision = 'SUPERSEDE', target, null)").alias("target"))


def near_classes(log: DataFrame, threshold: tuple[int, int] = (1, 2)) -> tuple[DataFrame, DataFrame]:
    """Members (line_num, id, members): every row with words and its class of equal word sets, by the first row; and pairs
    (id_a, id_b, similarity), id_a < id_b, of *different* sets above the threshold.

    Sets are posted under their rare-first prefix words by size band; sizes, places and bit counts bound the overlap before
    pairs are made distinct and verified on their words.  Equal sets are one class first, so copies cost nothing.
    """
    num, den = threshold
    rows = log.where("line_num is not null and content is not null").select(F.col("line_num").cast("long").alias("id"), F.col("content").cast("string"))
    counts = log.sparkSession.sparkContext.broadcast(signatures.word_counts(rows, 1))  # of a fixed size
    signed = staged(rows.mapInArrow(signatures.signer(counts, num, den, 1, wide_from=12), signatures.SIGNED), "signed")
    sets = staged(signatures.classes(signed), "sets")
    small, large = signatures.postings(sets, num, den)
    met = small.alias("a").join(large.alias("b"), F.expr(f"a.tile = b.tile and (a.n < b.n or a.rep < b.rep) and {signatures.may_overlap(num, den)}"))
    pairs = staged(met.selectExpr("least(a.rep, b.rep) as id_a", "greatest(a.rep, b.rep) as id_b").distinct(), "candidates")
    words = rows.join(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "id", "left_semi").select("id", T.word_set(F.col("content")).alias("words"))
    both = pairs.join(words.select(F.col("id").alias("id_a"), F.col("words").alias("wa")), "id_a").join(words.select(F.col("id").alias("id_b"), F.col("words").alias("wb")), "id_b")
    both = both.withColumn("common", F.size(F.array_intersect("wa", "wb"))).withColumn("total", F.expr("size(wa) + size(wb) - common"))
    links = both.where(f"common * {den} > total * {num}").select("id_a", "id_b", F.round(F.col("common") / F.col("total"), 6).alias("similarity"))
    members = signed.select(F.col("id").alias("line_num"), *signatures.CLASS).join(sets.select(*signatures.CLASS, F.col("rep").alias("id"), "members"), signatures.CLASS)
    return members.select("line_num", "id", "members"), links


def near_pairs(log: DataFrame, threshold: tuple[int, int] = (1, 2)) -> DataFrame:
    return near_classes(log, threshold)[1]


def latest(versions: DataFrame, key: str = "line_num", version: str = "version") -> DataFrame:
    """Rows of a versioned table as they stand: the last version of each key.  This is how a line is replaced in an
    append-only table."""
    order = Window.partitionBy(key).orderBy(F.desc(version))
    return versions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def superseded(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """The log after its decisions: skipped rows are gone, a superseding row stands under its target's line (the last one
    wins): (line_num, content, version), version being the line it came from."""
    rows = log.where("line_num is not null").select("line_num", "content").join(decisions, "line_num").where("decision <> 'SKIP'")
    return latest(rows.select(F.coalesce("target", "line_num").alias("line_num"), "content", F.col("line_num").alias("version")))
