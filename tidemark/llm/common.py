"""What the corpus operators share: folders, words, keys and the expansion of classes into pairs.

Every operator selects the columns it needs by name first, so extra columns of any name
are harmless.  A row without an id takes no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.staging import new_folder, staged

__all__ = ["expand", "letter_key", "new_folder", "staged", "table", "tag_set", "words"]

#: Java regex for what separates words (letters, digits and ``_`` of any script are words).
NOT_WORD = r"[^\p{L}\p{N}_]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(content: Column) -> Column:
    """The words of a text in order, lower-cased; null gives no words."""
    split = F.split(F.lower(F.coalesce(content, F.lit(""))), NOT_WORD)
    return F.filter(split, lambda w: w != "")


def letter_key(text: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def tag_set(tags: Column) -> Column:
    """Sorted letter keys of the tags; null and empty ones are left out, a null array is empty."""
    keys = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: letter_key(F.coalesce(t, F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda t: t != "")))


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, from classes and their links.

    members: (id, rep, members), every row with its class; links: (rep_a, rep_b).  Only classes that
    have several members or a link are kept for the joins.
    """
    linked = links.selectExpr("explode(array(rep_a, rep_b)) as rep").distinct().withColumn("linked", F.lit(True))
    inside = staged(members.join(linked, "rep", "left").where("members > 1 or linked").select("id", "rep"), "members")
    same = inside.alias("a").join(inside.alias("b"), F.expr("a.rep = b.rep and a.id < b.id")).selectExpr("a.id as id_a", "b.id as id_b")
    a = inside.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = inside.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = links.join(a, "rep_a").join(b, "rep_b").where("x <> y").selectExpr("least(x, y) as id_a", "greatest(x, y) as id_b")
    return same.unionByName(across).distinct()
