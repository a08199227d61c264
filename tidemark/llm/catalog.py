"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cutoff, formatdup, history, mixing, neardup, packing, pii, setjoin, twopoisson
from tidemark.llm.common import table


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content) over the log and the curated entries."""
    log = table(spark, sf_dir, "memory_log").select(F.col("line_num").alias("id"), "content")
    core = table(spark, sf_dir, "core_tagged").select(F.col("core_id").alias("id"), "content")
    return log.unionByName(core)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twopoisson.found(table(spark, sf_dir, "memory_log"))


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twopoisson.beside_stale(table(spark, sf_dir, "memory_log"), table(spark, sf_dir, "idf_weights"), table(spark, sf_dir, "entry_cache"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.found(table(spark, sf_dir, "memory_log"), table(spark, sf_dir, "core_tagged"))


def p2_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.linked(table(spark, sf_dir, "memory_log"), table(spark, sf_dir, "core_tagged"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.found(table(spark, sf_dir, "memory_log"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(contents(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(contents(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.found(table(spark, sf_dir, "memory_log"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.collapsed(table(spark, sf_dir, "memory_log"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.found(table(spark, sf_dir, "memory_log"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.shares(table(spark, sf_dir, "memory_log"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixed.where("uses > 0").select("doc_id", "source", "n_tokens", "uses")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.marginals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "team_roster"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "team_roster"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name[:1] == "p" and name[1:2].isdigit() and callable(f)}
