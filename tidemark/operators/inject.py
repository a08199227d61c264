"""From search results to a budgeted context: tiers, cluster merge, budgets, assembly, acknowledgement gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions import text as T
from tidemark.functions.fixed import PROTECTED_TYPES, SYSTEM_MARKERS, TASK_NOTIFICATION
from tidemark.operators.dedup import latest

HEADER, WARM_HEADER, SUMMARY_EXTRA, LEAST_LEFT = 60, 40, 25, 200


def admitted(prompts: DataFrame) -> DataFrame:
    """(query_id, session_id, intent) of the prompts worth searching for; prompts: (query_id, prompt, session_id)."""
    p = F.col("prompt")
    noise = T.contains_any(F.substring(p, 1, 100), SYSTEM_MARKERS) | F.startswith(F.regexp_replace(p, f"^{T.SPACE}+", ""), F.lit(TASK_NOTIFICATION)) | F.startswith(T.strip(p), F.lit("/"))
    kept = prompts.where(p.isNotNull() & (F.length(p) >= 15) & ~noise)
    return kept.select("query_id", "session_id", T.intent(p).alias("intent")).where(F.length("intent") >= 3)


def tiered(results: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The results of tier HOT or WARM; fewer than two exact matches put a result in neither."""
    tier = F.when(F.col("exact_matches") < 2, None).when(F.col("score") >= config.hot, "HOT").when(F.col("score") >= config.warm, "WARM")
    return results.withColumn("tier", tier).where("tier is not null")


def clustered(hot: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, place, entry_id, kind, content, related) of the HOT results (query_id, rank, entry_id, kind, content).

    Protected corrections come first.  The others are merged greedily in rank order: a result joins the first cluster
    whose words it shares to `cluster` or more, and the words of a cluster grow with it.  One fold over the results of a
    query, of which there are at most as many as a search returns.
    """
    protected = F.col("kind").isin(PROTECTED_TYPES)
    item = F.struct("rank", "entry_id", F.col("kind").alias("kind"), "content", T.tokens(F.col("content")).alias("words"), F.coalesce(protected, F.lit(False)).alias("kept"))
    rows = hot.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    # clusters are built in the order of their first members: a fold gives each item the rank of its cluster
    step = f"""
      aggregate(filter(items, i -> not i.kept), cast(array() as array<struct<first: int, words: array<string>, n: int>>), (acc, i) ->
        case when exists(acc, c -> size(c.words) > 0 and size(i.words) > 0
             and size(array_intersect(c.words, i.words)) >= {config.cluster}D * size(array_union(c.words, i.words)))
        then transform(acc, (c, k) -> if(
             k = array_min(filter(transform(sequence(0, size(acc) - 1), j -> if(size(acc[j].words) > 0 and size(i.words) > 0
               and size(array_intersect(acc[j].words, i.words)) >= {config.cluster}D * size(array_union(acc[j].words, i.words)), j, null)), j -> j is not null)),
             named_struct('first', c.first, 'words', array_union(c.words, i.words), 'n', c.n + 1), c))
        else array_append(acc, named_struct('first', i.rank, 'words', i.words, 'n', 1)) end)"""
    rows = rows.withColumn("clusters", F.expr(step))
    kept = rows.select("query_id", F.explode(F.expr("filter(items, i -> i.kept)")).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("late"))
    heads = rows.select("query_id", F.explode("clusters").alias("c"), "items").select("query_id", F.expr("filter(items, i -> i.rank = c.first)[0]").alias("i"), F.col("c.n").alias("n"), F.lit(1).alias("late"))
    both = kept.unionByName(heads)
    content = F.expr("if(n > 1, concat(i.content, ' (+', n - 1, ' related)'), i.content)")
    order = Window.partitionBy("query_id").orderBy("late", "i.rank")
    return both.select("query_id", F.row_number().over(order).alias("place"), "i.entry_id", F.col("i.kind").alias("kind"), content.alias("content"), F.greatest(F.col("n") - 1, F.lit(0)).alias("related"))


def _within(rows: DataFrame, budget: str) -> DataFrame:
    """The rows up to the first that overflows: (query_id, place, entry), entries counted from `used`."""
    upto = F.sum(F.length("entry")).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", F.col("used") + upto).where(F.col("upto") <= F.expr(budget))


def budgeted(hot: DataFrame, warm: DataFrame, budgets: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, tier, place, entry, upto): what of HOT (query_id, place, kind, content) and WARM (query_id, place, kind,
    content) fits the budget, each up to its first overflow; budgets: (query_id, budget), else the configured one."""
    def with_budget(rows: DataFrame) -> DataFrame:
        if budgets is None:
            return rows.withColumn("budget", F.lit(config.budget))
        return rows.join(budgets, "query_id")

    kind = T.text(F.col("kind"))
    h = with_budget(hot).select("query_id", "place", "budget", F.concat(F.lit("### ["), kind, F.lit("]\n"), "content", F.lit("\n")).alias("entry"), F.lit(HEADER).alias("used"))
    h = _within(h, "budget")
    spent = hot.select("query_id").distinct().join(h.groupBy("query_id").agg(F.max("upto").alias("upto")), "query_id", "left").select("query_id", F.coalesce("upto", F.lit(HEADER)).alias("spent"))
    w = with_budget(warm).join(spent, "query_id", "left").withColumn("used", F.coalesce("spent", F.lit(0))).where("used < budget")
    w = w.select("query_id", "place", "budget", F.concat(F.lit("- ["), kind, F.lit("] "), T.preview(F.col("content"))).alias("entry"), (F.col("used") + WARM_HEADER).alias("used"))
    w = _within(w, "budget")
    pick = ["query_id", F.lit("HOT").alias("tier"), "place", "entry", "upto"]
    return h.select(*pick).unionByName(w.select("query_id", F.lit("WARM").alias("tier"), "place", "entry", "upto"))


def core_block(results: DataFrame, used: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, tier, place, entry, upto) of tiered curated results (query_id, rank, tier, section, content): HOT in full
    (300 characters), then WARM as previews, each up to its first overflow of the whole budget.

    used: (query_id, used), characters spent before; queries with 200 or fewer left get nothing.
    """
    rows = results.withColumn("used", F.lit(0)) if used is None else results.join(used, "query_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    rows = rows.where(config.budget - F.col("used") > LEAST_LEFT).withColumn("place", F.col("rank"))
    section = T.text(F.col("section"))
    short = F.when(F.length("content") > 300, F.concat(F.substring("content", 1, 297), F.lit("..."))).otherwise(F.col("content"))
    h = rows.where("tier = 'HOT'").withColumn("entry", F.concat(F.lit("**["), section, F.lit("]** "), short))
    h = _within(h, str(config.budget))
    spent = h.groupBy("query_id").agg(F.max("upto").alias("spent"))
    w = rows.where("tier = 'WARM'").join(spent, "query_id", "left").withColumn("used", F.coalesce("spent", "used")).withColumn("entry", F.concat(F.lit("- ["), section, F.lit("] "), T.preview(F.col("content"))))
    w = _within(w, str(config.budget))
    pick = ["query_id", "tier", "place", "entry", "upto"]
    return h.select(*pick).unionByName(w.select(*pick))


def ack_markers(hot: DataFrame, prompts: DataFrame) -> DataFrame:
    """(query_id, session_id, count, summary, intent) of the prompts with HOT results (query_id, place, kind, content)."""
    line = F.concat(F.lit("- ["), T.text(F.col("kind")), F.lit("] "), F.substring(F.get(F.split("content", "\n"), F.lit(0)), 1, 100))
    rows = hot.groupBy("query_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return rows.join(prompts.select("query_id", "session_id", "intent"), "query_id").select("query_id", "session_id", "count", F.expr("array_join(transform(lines, x -> x.line), '\n')").alias("summary"), "intent")


def current_markers(markers: DataFrame) -> DataFrame:
    """The marker of each session that holds: the last one of an append-only table of markers (session_id, version, ...)."""
    return latest(markers.where("session_id is not null"), "session_id")


def gate(markers: DataFrame, calls: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(session_id, created_at, event_id, ts): the first call within the time to live of each marker is blocked, and no
    other; a newer marker of the session takes the place of an older one.

    markers: (session_id, created_at, count); calls: (session_id, ts, event_id).  As an as-of join: markers and calls pass in
    time order, and each call looks at the last marker before it.
    """
    m = markers.where("session_id is not null and created_at is not null").select("session_id", F.col("created_at").alias("ts"), F.lit(None).cast("long").alias("event_id"), "count")
    c = calls.where("session_id is not null and ts is not null").select("session_id", "ts", "event_id", F.lit(None).cast("long").alias("count"))
    order = Window.partitionBy("session_id").orderBy("ts", F.asc_nulls_first("event_id"))
    seen = m.unionByName(c).withColumn("marker", F.last(F.when(F.col("event_id").isNull(), F.struct(F.col("ts").alias("at"), "count")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    late = F.unix_micros("ts") - F.unix_micros("marker.at")
    hits = seen.where(F.col("event_id").isNotNull() & (F.col("marker.count") > 0) & (late <= config.gate_seconds * 1_000_000))
    first = Window.partitionBy("session_id", "marker.at").orderBy("ts", "event_id")
    return hits.withColumn("n", F.row_number().over(first)).where("n = 1").select("session_id", F.col("marker.at").alias("created_at"), "event_id", "ts")
