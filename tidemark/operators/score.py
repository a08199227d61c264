"""The relevance score as one plan over a batch of queries.

Evidence is joined by key: exact tokens and aliases over postings, stems over stem postings, and substrings over the
vocabulary, blocked by trigrams.  Rows that share nothing never meet.  The evidence of one query and entry is then
gathered by one aggregation (a query has few tokens, so its arrays are short) and scored in plain expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions import text as T
from tidemark.functions.fixed import PRIORITY_TYPES


def partial_matches(query_words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, other): words of queries and of the vocabulary of which one holds the other, at half its length or more.

    The first letters of the shorter one, six at most, stand somewhere in the longer one, so both directions are equi-joins.  As
    the shorter one has half the length, of a word of eleven letters or more only pieces of six are needed.
    """
    def pieces(word: str):
        size = f"length({word})"
        spans = f"sequence(least(6, greatest(3, ({size} + 1) div 2)), least(6, {size}))"
        return F.explode(F.expr(f"array_distinct(flatten(transform({spans}, n -> transform(sequence(1, {size} - n + 1), i -> substring({word}, i, n)))))")).alias("piece")

    q = query_words.select("token").distinct()
    v = vocabulary.select(F.col("token").alias("other"))
    down = q.withColumn("piece", F.substring("token", 1, 6)).join(v.select("other", pieces("other")), "piece").where("length(token) <= length(other) and contains(other, token)")
    up = v.withColumn("piece", F.substring("other", 1, 6)).join(q.select("token", pieces("token")), "piece").where("length(other) < length(token) and contains(token, other)")
    both = down.select("token", "other").unionByName(up.select("token", "other"))
    return both.where("token <> other and 2 * least(length(token), length(other)) >= greatest(length(token), length(other))").distinct()


def alias_pairs(aliases: DataFrame) -> DataFrame:
    """(token, alias): the expansions of each key; nulls are left out."""
    return aliases.where("alias_key is not null").select(F.col("alias_key").alias("token"), F.explode("expansions").alias("alias")).where("alias is not null").distinct()


def evidence(query_tokens: DataFrame, posted: DataFrame, aliases: DataFrame, weights: DataFrame, vocabulary: DataFrame, only_exact: bool = False) -> DataFrame:
    """posted: (token, entry_id).  (query_id, entry_id, part, token, weight, stem): part x for tokens the entry has, a for aliases it has, s for stems it has,
    p for tokens that hold, or are held by, one of its words."""
    q = query_tokens.select("query_id", "token", "weight", "stem")
    exact = q.join(posted, "token").select("query_id", "entry_id", F.lit("x").alias("part"), "token", "weight", "stem")
    by_alias = q.join(alias_pairs(aliases), "token").join(posted.withColumnRenamed("token", "alias"), "alias").select("query_id", "entry_id", F.lit("a").alias("part"), "token", "weight", "stem").distinct()
    if only_exact:
        return exact.unionByName(by_alias)
    # stems: of the few query stems, the vocabulary words that have them, then their postings
    stems = q.select("query_id", "stem").distinct().join(weights.select(F.col("token").alias("stem"), "weight"), "stem", "left")
    stems = stems.select("query_id", "stem", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    by_stem = stems.join(vocabulary, "stem").join(posted, "token").select("query_id", "entry_id", F.lit("s").alias("part"), F.col("stem").alias("token"), "weight", "stem").distinct()
    # substrings: a word that the query has itself does not count
    near = q.join(partial_matches(q, vocabulary), "token")
    near = near.join(q.select("query_id", F.col("token").alias("other")), ["query_id", "other"], "left_anti")
    part = near.join(posted.withColumnRenamed("token", "other"), "other").select("query_id", "entry_id", F.lit("p").alias("part"), "token", "weight", "stem").distinct()
    return exact.unionByName(by_alias).unionByName(by_stem).unionByName(part)


def expanded_tokens(query_tokens: DataFrame, aliases: DataFrame, weights: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The query tokens with the weight of their stem and the words that are evidence for them: aliases, others (that hold them, or
    are held by them) and family (those of their stem)."""
    def lists(pairs: DataFrame, key: str, word: str, name: str) -> DataFrame:
        return pairs.groupBy(key).agg(F.collect_set(word).alias(name))

    stems = query_tokens.select("stem").distinct()
    family = lists(vocabulary.join(stems, "stem", "left_semi"), "stem", "token", "family")
    stems = stems.join(weights.select(F.col("token").alias("stem"), "weight"), "stem", "left").select("stem", F.coalesce("weight", F.lit(1.0)).alias("stem_weight"))
    rows = query_tokens.join(lists(alias_pairs(aliases), "token", "alias", "aliases"), "token", "left")
    rows = rows.join(lists(partial_matches(query_tokens, vocabulary), "token", "other", "others"), "token", "left")
    return rows.join(stems, "stem").join(family, "stem", "left")


def evidence_of_pairs(query_tokens: DataFrame, pairs: DataFrame, posted: DataFrame, aliases: DataFrame, weights: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The evidence of given pairs (query_id, entry_id): their words meet the tokens of their query, and no others."""
    q = query_tokens.select("query_id", "token", "weight", "stem")

    def evidence_from(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("query_id", "entry_id", F.lit(name).alias("part"), "token", "weight", "stem").distinct()

    met = pairs.join(posted.withColumnRenamed("token", "word"), "entry_id")
    exact = met.withColumnRenamed("word", "token").join(q, ["query_id", "token"])
    by_alias = met.join(alias_pairs(aliases).withColumnRenamed("alias", "word"), "word").join(q, ["query_id", "token"])
    stems = q.select("query_id", "stem").distinct().join(weights.select(F.col("token").alias("stem"), "weight"), "stem", "left").select("query_id", "stem", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    by_stem = met.join(vocabulary.withColumnRenamed("token", "word"), "word").select("query_id", "entry_id", "stem").distinct().join(stems, ["query_id", "stem"]).withColumn("token", F.col("stem"))
    words = vocabulary.join(posted.select("token").distinct(), "token", "left_semi")
    near = met.join(q.select("query_id", F.col("token").alias("word")), ["query_id", "word"], "left_anti")
    part = near.join(partial_matches(q, words).withColumnRenamed("other", "word"), "word").select("query_id", "entry_id", "token").distinct().join(q, ["query_id", "token"])
    return evidence_from(exact, "x").unionByName(evidence_from(by_alias, "a")).unionByName(evidence_from(by_stem, "s")).unionByName(evidence_from(part, "p"))


def _sum(array: str) -> str:
    return f"aggregate({array}, cast(0 as double), (s, x) -> s + x.weight)"


def scored(query_tokens: DataFrame, found: DataFrame, entries: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, entry_id, match, n_exact, score) of every pair with evidence and a score above 0, rounded to six places."""
    def part(name: str):
        return F.array_sort(F.collect_set(F.when(F.col("part") == name, F.struct("token", "weight", "stem")))).alias(name)

    gathered = found.groupBy("query_id", "entry_id").agg(part("x"), part("a"), part("s"), part("p"))
    of_query = query_tokens.groupBy("query_id").agg(F.sum("weight").alias("total"), F.count("*").alias("n_query"), F.collect_list("token").alias("query"))
    attributes = entries.select(
        "entry_id", F.lower(T.text(F.col("kind"))).alias("kind"), "priority", "age_days", F.size("tokens").alias("n_tokens"),
        "tag_tokens",
    )
    rows = gathered.join(attributes, "entry_id").join(of_query, "query_id")
    rows = rows.withColumn("exact", F.expr("array_sort(array_union(x, a))"))
    rows = rows.withColumn("exact_stems", F.expr("transform(exact, e -> e.stem)"))
    rows = rows.withColumn("stem_only", F.expr("filter(s, e -> not array_contains(exact_stems, e.token))"))
    rows = rows.withColumn("partial", F.expr("filter(p, e -> not array_contains(transform(exact, k -> k.token), e.token))"))
    match = (
        f"case when size(exact) > 0 then ({_sum('exact')} + 0.7D * {_sum('stem_only')} + 0.25D * {_sum('partial')}) / total"
        f" when size(s) > 0 then 0.7D * {_sum('s')} / total else 0.5D * {_sum('partial')} / total end"
    )
    rows = rows.withColumn("match", F.expr(match)).withColumn("n_exact", F.size("exact"))
    strong = "round(match, 9) >= 0.3D or (round(match, 9) >= 0.15D and n_exact > 0)"
    kinds = ", ".join(f"'{k}'" for k in PRIORITY_TYPES)
    score = (
        f"match * if(({strong}) and n_query >= 3, if(arrays_overlap(query, tag_tokens), 2.0D, 1.0D) * if(kind in ({kinds}), 1.5D, 1.0D), 1.0D)"
        f" * (1 + 0.1D * priority) * exp(-{config.decay_rate}D * age_days)"
        " * if(n_exact > 0 and n_tokens > 3, least(greatest(3D * size(x) / sqrt(n_tokens), 0.15D), 1.0D), 1.0D)"
    )
    return rows.select("query_id", "entry_id", F.round("match", 6).alias("match"), "n_exact", F.round(F.expr(score), 6).alias("score")).where("score > 0")
