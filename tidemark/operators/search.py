"""Batched ranked retrieval over the log and the curated entries."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions import text as T
from tidemark.operators import corpus, score, topk
from tidemark.operators.staging import exists, new_folder, shared_dir, staged, stamp, touch


@dataclass
class Index:
    """What all searches share: entries past the quality gate, their postings, word weights, vocabulary, aliases, and the folder of
    the entries packed by age."""

    entries: DataFrame
    postings: DataFrame
    weights: DataFrame
    vocabulary: DataFrame
    aliases: DataFrame
    packed: str
    config: EngineConfig = DEFAULT


_SIDES = ("log", "core")


def write_index(log: DataFrame, core: DataFrame, folder: str, config: EngineConfig = DEFAULT) -> None:
    """The prepared tables of log and curated entries; weights are those of both together.  Texts are tokenised and judged
    once; postings are kept in token order, so a search reads the row groups of its tokens."""
    spark = log.sparkSession
    for side, entries in zip(_SIDES, (corpus.log_entries(log, config), corpus.core_entries(core))):
        rows = entries.withColumn("tag_tokens", T.tokens(T.tags_text(F.col("tags")))).withColumn("good", corpus.passes(entries))
        rows.write.mode("overwrite").parquet(f"{folder}/{side}")
    every = [spark.read.parquet(f"{folder}/{side}") for side in _SIDES]
    corpus.idf(*every).write.mode("overwrite").parquet(f"{folder}/weights")
    for side, entries in zip(_SIDES, every):
        posted = corpus.postings(entries.where("good")).hint("rebalance", F.col("token")).sortWithinPartitions("token")
        posted.write.mode("overwrite").parquet(f"{folder}/{side}-postings")
        words = spark.read.parquet(f"{folder}/{side}-postings").select("token").distinct()
        words.select("token", T.stem("token").alias("stem")).write.mode("overwrite").parquet(f"{folder}/{side}-vocabulary")
        topk.pack(entries.where("good"), f"{folder}/{side}-packed")


def read_index(spark: SparkSession, folder: str, aliases: DataFrame, config: EngineConfig = DEFAULT) -> tuple[Index, Index]:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    log, core = (Index(table(s).where("good").drop("good"), table(f"{s}-postings"), table("weights"), table(f"{s}-vocabulary"), aliases, f"{folder}/{s}-packed", config) for s in _SIDES)
    return log, core


def build(log: DataFrame, core: DataFrame, aliases: DataFrame, config: EngineConfig = DEFAULT) -> tuple[Index, Index]:
    """The indexes of log and curated entries, written anew."""
    folder = new_folder(log.sparkSession, "index")
    write_index(log, core, folder, config)
    return read_index(log.sparkSession, folder, aliases, config)


def opened(spark: SparkSession, log_path: str, core_path: str, aliases: DataFrame, config: EngineConfig = DEFAULT) -> tuple[Index, Index]:
    """The indexes of stored tables, kept in the shared folder under the state of their files (names, lengths and times) and
    the settings: as long as no file changes, every search of every session uses the same one."""
    name = hashlib.md5("|".join([stamp(spark, log_path), stamp(spark, core_path), repr(config)]).encode()).hexdigest()
    folder = f"{shared_dir(spark)}/index-{name}"
    if not exists(spark, f"{folder}/packed-done"):
        write_index(spark.read.parquet(log_path), spark.read.parquet(core_path), folder, config)
        touch(spark, f"{folder}/packed-done")
    return read_index(spark, folder, aliases, config)


def tokens_of(texts: DataFrame, index: Index, prune: bool = True) -> DataFrame:
    return corpus.pruned(corpus.queries_of(texts), index.weights, index.config.query_tokens if prune else None)


def search(texts: DataFrame, index: Index, k: int | None = None, only_exact: bool = False, cached: bool = False, least: float = 0.0) -> DataFrame:
    """(query_id, entry_id, match, n_exact, score, rank); texts: (query_id, text).  Queries without tokens find nothing, and of
    scores under `least` none needs to be found.  The cached mode drops entries that match by substring alone."""
    spark = texts.sparkSession
    tokens = staged(tokens_of(texts, index).where("query_id is not null"), "query-tokens")
    asked = score.expanded_tokens(tokens, index.aliases, index.weights, index.vocabulary)
    item = F.struct("token", "weight", "stem", "stem_weight", "aliases", "others", "family")
    asked = asked.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_list(item).alias("tokens"))
    asked = asked.repartition(2 * spark.sparkContext.defaultParallelism, "query_id")
    run = topk.searcher(index.packed, k or index.config.top_k, index.config.decay_rate, least, only_exact, cached)
    return asked.mapInArrow(run, topk.FOUND).select("query_id", "entry_id", "match", "n_exact", "score", "rank")


def prefiltered(texts: DataFrame, index: Index) -> DataFrame:
    """(query_id, entry_id) that share a token, an alias or a stem: the candidates of the cached mode."""
    tokens = tokens_of(texts, index)
    found = score.evidence(tokens, index.postings, index.aliases, index.weights, index.vocabulary)
    return found.where("part <> 'p'").select("query_id", "entry_id").distinct()


def rescored(candidates: DataFrame, texts: DataFrame, index: Index) -> DataFrame:
    """(query_id, entry_id, score) of given candidates against all tokens of the queries (no pruning), above 0."""
    tokens = staged(tokens_of(texts, index, prune=False), "query-tokens")
    pairs = staged(candidates.select("query_id", "entry_id").distinct(), "candidates")
    entries = staged(index.entries.join(pairs.select("entry_id").distinct(), "entry_id", "left_semi"), "candidate-entries")
    found = score.evidence_of_pairs(tokens, pairs, corpus.postings(entries), index.aliases, index.weights, index.vocabulary)
    return score.scored(tokens, found, entries, index.config).select("query_id", "entry_id", "score")


def unknown(texts: DataFrame, index: Index) -> DataFrame:
    """(query_id) of the texts whose first 80 characters find no entry with a score above `same`."""
    starts = texts.select("query_id", F.substring("text", 1, 80).alias("text"))
    known = search(starts, index, 1, least=index.config.same).where(F.col("score") > index.config.same)
    return texts.select("query_id").join(known, "query_id", "left_anti")


def expanded(texts: DataFrame, expansions: DataFrame) -> DataFrame:
    """The queries with their extra terms (query_id, extra) appended; queries without stay as they are."""
    return texts.join(expansions, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "extra").alias("text"))


def alias_expansions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, extra): the deterministic default of query expansion, all expansions of a query's words."""
    words = texts.select("query_id", F.explode(T.word_set(F.col("text"))).alias("token"))
    extra = words.join(score.alias_pairs(aliases), "token").groupBy("query_id").agg(F.array_sort(F.collect_set("alias")).alias("extra"))
    return extra.select("query_id", F.array_join("extra", " ").alias("extra"))


def exact_counts(results: DataFrame, texts: DataFrame, entries: DataFrame) -> DataFrame:
    """The results with exact_matches: tokens of the query among those of content and tags."""
    rows = results.join(texts.select("query_id", T.tokens(F.col("text")).alias("q")), "query_id")
    words = entries.select("entry_id", T.tokens(F.concat_ws(" ", "content", T.tags_text(F.col("tags")))).alias("e"))
    return rows.join(words, "entry_id").withColumn("exact_matches", F.size(F.array_intersect("q", "e"))).drop("q", "e")


def fused(branches: list[DataFrame], entries: DataFrame, seen: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, entry_id, score, rank) of several result lists in one: the best of each content start of 80 characters,
    without those whose start is among `seen` (query_id, key); ties go to the earlier list, then the better rank."""
    rows = None
    for i, b in enumerate(branches):
        b = b.select("query_id", "entry_id", "score", F.lit(i).alias("branch"), F.col("rank").alias("place"))
        rows = b if rows is None else rows.unionByName(b)
    rows = rows.join(entries.select("entry_id", F.substring("content", 1, 80).alias("start")), "entry_id")
    rows = rows.withColumn("key", F.lower("start")).join(seen, ["query_id", "key"], "left_anti")
    best = Window.partitionBy("query_id", "start").orderBy(F.desc("score"), "branch", "place")
    once = rows.withColumn("n", F.row_number().over(best)).where("n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "branch", "place")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "entry_id", "score", "rank")
