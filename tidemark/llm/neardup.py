"""Near-duplicate records with small edits: size-banded tiles with bitmap signatures.

1. Records become sets of words; equal sets are one class from then on.
2. Each class is posted under its rare-first prefix words, split into size bands.  The postings of
   one word and band form a tile; only sets of one tile are compared.
3. In a tile, sizes, places and the bit counts of the bitmaps bound the overlap from above; the
   few pairs that pass are verified on their words by an exact array intersection.

Work follows the number of sets that share a *rare* word and a size, not the square of the table.
Large tiles are sort-merge joined, which AQE splits by skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import expand, staged, words
from tidemark.operators.signatures import CLASS, SIGNED, classes, may_overlap, needed, postings, signer, word_counts

MIN_WORDS = 12
NUM, DEN = 8, 10


def verified(pairs: DataFrame, texts: DataFrame, num: int = NUM, den: int = DEN, other: DataFrame | None = None) -> DataFrame:
    """The pairs (id_a, id_b, ...) whose texts (id, content) share num / den of their distinct words, by an intersection of
    the sorted words.  Only the texts of candidates are moved.  other: (rep, content), the texts of the second one where a
    column old says so."""
    own = ["id_a", "id_b"] if other is None else ["id_a", "if(old, null, id_b)"]
    ids = pairs.select(F.explode(F.expr(f"array_compact(array({', '.join(own)}))")).alias("id")).distinct()
    bag = texts.join(ids, "id", "left_semi").select("id", "content")  # one exchange serves both sides
    a = bag.select(F.col("id").alias("id_a"), F.col("content").alias("content_a"))
    b = bag.select(F.col("id").alias("id_b"), F.col("content").alias("content_b"))
    if other is not None:
        more = other.withColumnRenamed("rep", "id_b").join(pairs.where("old").select("id_b").distinct(), "id_b", "left_semi")
        b = b.unionByName(more.select("id_b", F.col("content").alias("content_b")))
    # texts travel as they are, which is half the size of their words
    both = pairs.join(a, "id_a").join(b, "id_b").select(*pairs.columns, _sorted_words("content_a").alias("words_a"), _sorted_words("content_b").alias("words_b"))
    return both.where(f"size(array_intersect(words_a, words_b)) >= {needed('size(words_a)', 'size(words_b)', num, den)}").select(*pairs.columns)


def _sorted_words(content: str) -> Column:
    return F.array_sort(F.array_distinct(words(F.col(content))))


def near_classes(rows: DataFrame, min_words: int = MIN_WORDS, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """rows: (id, content).  Returns
      members (id, rep, members): every row of min_words or more distinct words and its class of equal word sets,
      links (rep_a, rep_b): the pairs of different classes with a similarity of num / den or more.

    Null, empty and short contents are in no class.  Ids are taken as unique.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long"), F.col("content").cast("string")).where("id is not null and content is not null")
    counts = spark.sparkContext.broadcast(word_counts(rows, min_words))
    signed = staged(rows.mapInArrow(signer(counts, num, den, min_words), SIGNED), "signed")
    groups = classes(signed)
    members, visitors = postings(groups, num, den)
    pairs = (
        members.alias("a")
        .join(visitors.alias("b"), on=F.expr(f"a.tile = b.tile and (a.n < b.n or a.rep < b.rep) and {may_overlap(num, den)}"))
        .selectExpr("least(a.rep, b.rep) as id_a", "greatest(a.rep, b.rep) as id_b")
        .distinct()
    )
    links = staged(verified(staged(pairs, "candidates"), rows, num, den).selectExpr("id_a as rep_a", "id_b as rep_b"), "links")
    rows_of = signed.select("id", *CLASS).join(groups.select(*CLASS, "rep", "members"), CLASS).select("id", "rep", "members")
    return rows_of, links


def found(rows: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of rows that say nearly the same."""
    return expand(*near_classes(rows))


def groups(rows: DataFrame) -> DataFrame:
    """One row for each record of enough words: (id, class_id, class_size, n_links); n_links counts the
    linked classes other than its own."""
    members, links = near_classes(rows)
    degree = links.selectExpr("explode(array(rep_a, rep_b)) as rep").groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(degree, "rep", "left").select("id", F.col("rep").alias("class_id"), F.col("members").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
