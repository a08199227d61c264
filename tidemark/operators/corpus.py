"""Prepared entries, postings, vocabulary and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions import text as T


def log_entries(log: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(entry_id, kind, content, tags, section, priority, age_days, session_id, tokens) of the memory log.

    Null contents, tags and types count as empty; a malformed or missing time means age 0.  Rows without
    line_num are left out.
    """
    return log.where("line_num is not null").select(
        F.col("line_num").alias("entry_id"), F.col("type").alias("kind"), T.text(F.col("content")).alias("content"), "tags",
        F.lit(None).cast("string").alias("section"), F.lit(0).alias("priority"), T.age_days(T.iso_time(F.col("logged_at")), config.now).alias("age_days"),
        "session_id", T.tokens(T.searchable(F.col("content"), F.col("tags"), F.col("type"))).alias("tokens"),
    )


def core_entries(core: DataFrame) -> DataFrame:
    """The same of the curated entries, which are timeless: their age is 0."""
    return core.where("core_id is not null").select(
        F.col("core_id").alias("entry_id"), F.col("type").alias("kind"), T.text(F.col("content")).alias("content"), "tags", "section",
        F.coalesce("priority", F.lit(0)).alias("priority"), F.lit(0.0).alias("age_days"), F.lit(None).cast("string").alias("session_id"),
        T.tokens(T.searchable(F.col("content"), F.col("tags"), F.col("type"), F.col("section"))).alias("tokens"),
    )


def idf(*entries: DataFrame) -> DataFrame:
    """(token, df, weight) over all given entries: weight = ln(1 + N / df)."""
    tokens = entries[0].select("tokens")
    for e in entries[1:]:
        tokens = tokens.unionByName(e.select("tokens"))
    total = tokens.agg(F.count("*")).scalar()
    return tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).select("token", "df", F.log(1 + total / F.col("df")).alias("weight"))


def passes(entries: DataFrame) -> Column:
    return T.worth_surfacing(F.col("content")) & (F.size("tokens") > 0)


def surfacing(entries: DataFrame) -> DataFrame:
    """The entries that pass the quality gate; it stands before every join."""
    return entries.where(passes(entries))


def postings(entries: DataFrame) -> DataFrame:
    return entries.select("entry_id", F.explode("tokens").alias("token"))


def vocabulary(entries: DataFrame) -> DataFrame:
    """(token, stem): stems are made once for each word, not for each posting."""
    return postings(entries).select("token").distinct().select("token", T.stem("token").alias("stem"))


def queries_of(texts: DataFrame) -> DataFrame:
    """(query_id, token): the distinct tokens of (query_id, text)."""
    return texts.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def pruned(query_tokens: DataFrame, weights: DataFrame, keep: int | None) -> DataFrame:
    """(query_id, token, weight, rank_weight, stem).  Of a query of more than `keep` tokens those of the highest weight stay; a
    token the corpus lacks ranks with the highest weight there is, and weighs 1 in the score.  Ties go by name."""
    known = query_tokens.join(weights.select("token", "weight"), "token", "left").withColumn("most", weights.agg(F.max("weight")).scalar())
    ranked = known.select("query_id", "token", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("weight", "most", F.lit(1.0)).alias("rank_weight"), T.stem("token").alias("stem"))
    if keep is None:
        return ranked
    # weights of equal df differ in no bit, so the order is the same everywhere
    order = Window.partitionBy("query_id").orderBy(F.desc("rank_weight"), "token")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")
