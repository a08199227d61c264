"""Mixing sources to target weights by iterative proportional fitting.

1. Texts are measured in tokens; sources, languages and topics are normalised and summed up in cells.
2. The cells' weights are raked, in turn, to the marginals of language, topic and source until all agree.
   Source shares are the targets; the shares of languages and topics are given, or flattened (FLATTEN) within each
   source and summed up with the source shares, so that all three can be met at once.
3. The weights are scaled to the largest mixture in which no record is needed more often than its source
   allows.  A record's weight is then its expected number of uses.
4. Records are drawn by systematic sampling: a source's records pass from large to small, in random order within
   a size class, and each gets its expected uses rounded up or down such that the tokens used so far stay next to
   the tokens expected so far.  What the large records leave over or open, the small ones settle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.tokens import VOCABULARY, counted

#: Records of a block, which one task draws from; a large source has many.
BLOCK = 50_000
#: Most cells of source, language and topic; they are weighed on the driver and broadcast (some 12 MB).  More are an error.
MOST_CELLS = 200_000
#: Without shares given, languages and topics aim at their shares within each source to this power, which raises the rare ones.
FLATTEN = 0.9
ROUNDS, CLOSE = 200, 1e-10


def spelled(name: Column) -> Column:
    """A name without case and outer blanks."""
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def plain(name: Column) -> Column:
    """A language or topic without its spelling variants: case, outer blanks, region suffix."""
    return F.regexp_replace(spelled(name), r"-[a-z0-9]+$", "")


def source_of(name: Column, known: list[str]) -> Column:
    """The known source a name stands for: as spelled, else without a suffix; null for none."""
    if not known:
        return F.lit(None).cast("string")
    return F.coalesce(F.when(spelled(name).isin(known), spelled(name)), F.when(plain(name).isin(known), plain(name)))


def rake(mass: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the cells for which the weighted mass has the target shares in every grouping; the last grouping
    is met exactly.  groups: for each grouping the group of each cell."""
    weight = np.ones(len(mass))
    for _ in range(rounds):
        worst = 0.0
        for group, target in zip(groups, targets):
            now = np.bincount(group, weight * mass, len(target))
            now = now / now.sum()
            worst = max(worst, np.abs(now - target).max())
            weight = weight * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[group]
        if worst < CLOSE:
            break
    return weight


def flattened(mass: np.ndarray, source: np.ndarray, group: np.ndarray, share: np.ndarray, power: float) -> np.ndarray:
    """Shares of the groups if in every source they had their own share to the given power."""
    table = np.zeros((len(share), group.max() + 1))
    np.add.at(table, (source, group), mass)
    table = np.where(table > 0, (table / table.sum(axis=1, keepdims=True)) ** power, 0.0)
    return share @ (table / table.sum(axis=1, keepdims=True))


def _goals(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and most repeats of each source; targets are a short list of settings."""
    goal: dict[str, tuple[float, int]] = {}
    for name, share, most in targets.select(spelled(F.col("source")), "target_share", "max_repeats").collect():
        if name and share and share > 0:
            before = goal.get(name, (0.0, 1))
            goal[name] = (before[0] + share, max(most or 1, before[1]))
    return goal


def _measured(documents: DataFrame, sources: list[str], vocabulary: str) -> DataFrame:
    docs = documents.select("doc_id", "text", source_of(F.col("source"), sources).alias("source"), F.coalesce(plain(F.col("lang")), F.lit("und")).alias("lang"), F.coalesce(plain(F.col("kind")), F.lit("und")).alias("topic"))
    return staged(counted(docs.where("source is not null"), "source", "lang", "topic", vocabulary=vocabulary), "tokens")


MIXED = "doc_id long, source string, lang string, topic string, n_tokens long, expected_uses double, uses int"


def mixture(documents: DataFrame, targets: DataFrame, language_shares: dict[str, float] | None = None, topic_shares: dict[str, float] | None = None, vocabulary: str = VOCABULARY, flatten: float = FLATTEN) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, expected_uses, uses) of every record of a target's source; uses may be 0.

    Records of null or other sources and null or empty texts are left out.  Targets without a positive share
    or without any record get nothing; the shares of the others are taken relative to their sum.  Targets of one name
    add up, and the largest number of repeats holds.  Given shares of languages or topics may contradict those of the
    sources; the latter are met in any case.
    """
    spark = documents.sparkSession
    goal = _goals(targets)
    rows = _measured(documents, list(goal), vocabulary)
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("records")).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of source, language and topic; normalise their names first")
    cells.sort(key=lambda c: (c["source"], c["lang"], c["topic"]))
    if not cells:
        return spark.createDataFrame([], MIXED)

    mass = np.array([c["n"] for c in cells], float)
    axes, groups = [], []
    for column in ("lang", "topic", "source"):
        values = sorted({c[column] for c in cells})
        at = {v: i for i, v in enumerate(values)}
        axes.append(values)
        groups.append(np.array([at[c[column]] for c in cells]))
    share = np.array([goal[s][0] for s in axes[2]])
    share = share / share.sum()
    wanted = []
    for axis, group, given in zip(axes, groups, (language_shares, topic_shares)):
        t = np.array([max(given.get(v, 0.0), 0.0) for v in axis]) if given else flattened(mass, groups[2], group, share, flatten)
        wanted.append(t / t.sum())
    weight = rake(mass, groups, [*wanted, share])
    most = np.array([goal[c["source"]][1] for c in cells], float)
    weight = weight * (most[weight > 0] / weight[weight > 0]).min()

    table = spark.createDataFrame([(c["source"], c["lang"], c["topic"], float(min(w, m))) for c, w, m in zip(cells, weight, most)], "source string, lang string, topic string, expected_uses double")
    records = {s: sum(c["records"] for c in cells if c["source"] == s) for s in axes[2]}
    blocks = F.create_map(*[F.lit(x) for s, n in records.items() for x in (s, -(-n // BLOCK))])
    weighed = rows.join(F.broadcast(table), ["source", "lang", "topic"])  # one row for each cell, a bounded number
    weighed = weighed.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks[F.col("source")]))
    return weighed.select("doc_id", "source", "lang", "topic", "n_tokens", "expected_uses", "block", F.xxhash64("doc_id", F.lit(7)).alias("at")).groupBy("source", "block").applyInArrow(_draw, MIXED)


def _draw(block: pa.Table) -> pa.Table:
    n, expected = block["n_tokens"].to_numpy(), block["expected_uses"].to_numpy()
    order = np.lexsort((block["doc_id"].to_numpy(), block["at"].to_numpy(), -np.floor(np.log2(n))))
    uses = np.zeros(len(n), np.int32)
    # rounding errors of the last places must not cost a certain use
    low, high = np.floor(expected + 1e-9), np.ceil(expected - 1e-9)
    due = 0.0
    for i in order:
        due += expected[i] * n[i]
        uses[i] = k = min(max(np.floor(due / n[i] + 0.5), low[i]), high[i])
        due -= k * n[i]
    return block.select(["doc_id", "source", "lang", "topic", "n_tokens", "expected_uses"]).append_column("uses", pa.array(uses))


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_share, actual_share, n_records, n_uses, n_tokens, most_uses) of every target."""
    mixed = mixture(documents, targets, vocabulary=vocabulary).where("uses > 0")
    by = mixed.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("uses").alias("n_uses"), F.sum(F.expr("uses * n_tokens")).alias("n_tokens"), F.max("uses").alias("most_uses"))
    all_of = by.withColumn("actual_share", F.expr("n_tokens / sum(n_tokens) over ()"))
    goal = targets.select(spelled(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    zero = {c: 0 for c in ("n_records", "n_uses", "n_tokens", "most_uses", "actual_share")}
    return goal.join(all_of, "source", "left").fillna(zero).select("source", "target_share", "actual_share", "n_records", "n_uses", "n_tokens", "most_uses")


def marginals(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(axis, value, natural_share, expected_share, actual_share): what every source, language and topic has of the tokens of all
    eligible records, of the raked weights, and of the drawn mixture."""
    mixed = mixture(documents, targets, vocabulary=vocabulary)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in ("source", "lang", "topic")])).alias("p")
    sums = mixed.select(pairs, "n_tokens", (F.col("expected_uses") * F.col("n_tokens")).alias("expected"), (F.col("uses") * F.col("n_tokens")).alias("actual"))
    by = sums.groupBy("p.axis", "p.value").agg(F.sum("n_tokens").alias("natural"), F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    return by.select("axis", "value", *[F.expr(f"{c} / sum({c}) over (partition by axis)").alias(f"{c}_share") for c in ("natural", "expected", "actual")])
