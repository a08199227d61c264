"""Extraction of corrections, decisions, plan reasoning and session summaries from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions import text as T
from tidemark.functions.fixed import (
    CHECKPOINT_SKIPPED_TAGS, CORRECTION_PATTERNS, CORRECTION_SIGNALS, CORRECTION_TYPES, DECISION_PATTERNS, PLAN_SECTION, PLAN_SENTENCES,
    SNIPPETS_HEAD, SUMMARY_SKIPPED_TAGS, TOPICS_HEAD, VALID_TYPES, WEAK_SIGNALS,
)
from tidemark.operators import dedup, search
from tidemark.operators.staging import staged


def portable(pattern: str) -> str:
    """The pattern with Unicode classes spelled out, so that every engine reads it alike."""
    return pattern.replace(r"\s", T.SPACE).replace(r"\w", r"[\p{L}\p{N}_]")


def has_signals(prompt: Column) -> Column:
    return T.contains_any(F.lower(T.text(prompt)), CORRECTION_SIGNALS)


def weak_signals(prompt: Column) -> Column:
    """Whether a prompt without a correction is worth a second look."""
    return (F.length(T.text(prompt)) >= 50) & T.contains_any(F.lower(T.text(prompt)), WEAK_SIGNALS)


def _first_sentence(c: Column) -> Column:
    """Over 120 characters, the text ends with the first . or ! or ? (in this order) after its 41st and before its 200th."""
    def at(ch: str) -> Column:
        p = F.locate(ch, c, 41)
        return F.when((p > 41) & (p < 201), p)

    end = F.coalesce(*[at(ch) for ch in ".!?"])
    return F.when((F.length(c) > 120) & end.isNotNull(), F.substring(c, F.lit(1), end)).otherwise(c)


def corrections(prompts: DataFrame) -> DataFrame:
    """(query_id, type, content, full_prompt): the first pattern whose cleaned text has ten characters decides.
    Null prompts and prompts without a pattern are left out."""
    p = T.strip(F.col("prompt"))
    options = []
    for pattern, group, kind in CORRECTION_PATTERNS:
        # as arrays, so that a pattern is matched once and none after the first hit
        option = F.array(F.struct(F.lit(kind).alias("type"), T.squeezed(F.regexp_extract(p, "(?isu)" + portable(pattern), group)).alias("content")))
        options.append(F.get(F.filter(option, lambda o: F.length(o["content"]) >= 10), F.lit(0)))
    hits = F.array_compact(F.array(F.coalesce(*options)))
    hit = prompts.where("prompt is not null").select("query_id", F.explode(hits).alias("hit"), F.substring("prompt", 1, 500).alias("full_prompt"))
    return hit.select("query_id", "hit.type", F.substring(_first_sentence(F.col("hit.content")), 1, 300).alias("content"), "full_prompt")


def repetition(texts: DataFrame, index: search.Index) -> DataFrame:
    """(query_id, best): the best score among the three best results of each text that are corrections; 0 without any."""
    kinds = index.entries.select("entry_id", "kind")
    top = search.search(texts, index, 3).join(kinds, "entry_id").where(F.col("kind").isin(CORRECTION_TYPES))
    best = top.groupBy("query_id").agg(F.max("score").alias("best"))
    return texts.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("best"))


def pipeline(prompts: DataFrame, index: search.Index, log: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, type, content, tags, decision, target) of the corrections to be stored: long enough, with signals, a whole
    sentence, not nearly identical to one stored before; one that repeats becomes REPEATED_CORRECTION.  The decision is that
    of an append to the log as it stands."""
    able = prompts.where((F.length("prompt") >= 20) & has_signals(F.col("prompt")))
    found = staged(corrections(able).where(T.worth_storing(F.col("content"))), "corrections")
    seen = repetition(found.select("query_id", F.col("content").alias("text")), index)
    rows = found.join(seen, "query_id").where(F.col("best") <= config.same)
    again = F.col("best") > config.repeat
    tags = F.concat(T.smart_tags(F.col("content"), F.col("full_prompt")), T.strings(["user_correction", "auto_detected"]), F.when(again, T.strings(["repeated"])).otherwise(F.array().cast("array<string>")))
    decided = dedup.snapshot_decisions(found.select(F.col("query_id").alias("id"), "content"), log, config).withColumnRenamed("id", "query_id")
    return rows.join(decided, "query_id").select("query_id", F.when(again, "REPEATED_CORRECTION").otherwise(F.col("type")).alias("type"), "content", F.array_join(tags, ",").alias("tags"), "decision", "target")


def _matches(texts: DataFrame) -> DataFrame:
    """(doc_id, pattern, at, type, content): what the decision patterns find, each start of 50 characters of a text once."""
    t = T.text(F.col("text"))

    def found(n: int, pattern: str, kind: str) -> Column:
        all_of = F.regexp_extract_all(t, F.lit("(?iud)" + portable(pattern)), F.lit(1))
        return F.transform(all_of, lambda x, i: F.struct(F.lit(n).alias("pattern"), i.alias("at"), F.lit(kind).alias("type"), x.alias("raw")))

    each = F.array(*[found(n, p, k) for n, (p, k) in enumerate(DECISION_PATTERNS)])
    rows = texts.where("doc_id is not null").select("doc_id", F.explode(F.flatten(each)).alias("m")).select("doc_id", "m.pattern", "m.at", "m.type", F.substring(F.regexp_replace(T.strip(F.col("m.raw")), r"[\n\r]+", " "), 1, 300).alias("content"))
    rows = rows.where((F.length("content") >= 50) & T.verb_like(F.col("content")))
    once = Window.partitionBy("doc_id", F.lower(F.substring("content", 1, 50))).orderBy("pattern", "at")
    return rows.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")


def _first(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("pattern", "at")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("doc_id", "place", "type", "content")


def decisions(texts: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, place, type, content): what the patterns find in each text, in pattern and text order, each start of 50
    characters once, at most `most` for a text (the operator's own limit)."""
    return _first(_matches(texts), most)


def new_decisions(texts: DataFrame, index: search.Index, most: int = 10) -> DataFrame:
    """The same without those the log has something very similar to: what is known takes no place among the `most`."""
    rows = staged(_matches(texts).withColumn("query_id", F.xxhash64("doc_id", "pattern", "at")), "decisions")
    fresh = search.unknown(rows.select("query_id", F.col("content").alias("text")), index)
    return _first(rows.join(fresh, "query_id"), most)


def plan_reasoning(plans: DataFrame) -> DataFrame:
    """(doc_id, content) of the sections and sentences of a plan that give reasons, over 50 characters, 500 of them."""
    t = T.text(F.col("text"))
    parts = [F.regexp_extract_all(t, F.lit("(?im)" + PLAN_SECTION), F.lit(1))] + [F.regexp_extract_all(t, F.lit("(?imd)" + p), F.lit(0)) for p in PLAN_SENTENCES]
    return plans.select("doc_id", F.explode(reduce(F.concat, parts)).alias("m")).select("doc_id", T.strip(F.col("m")).alias("m")).where("length(m) > 50").select("doc_id", F.substring("m", 1, 500).alias("content"))


def incremental(texts: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, part): what came after the saved offset (doc_id, offset), or the whole text where there is none in its
    range; parts under 100 characters wait."""
    rows = texts.where("doc_id is not null and text is not null").join(offsets, "doc_id", "left")
    part = F.expr("if(offset > 0 and offset < length(text), substring(text, cast(offset as int) + 1), text)")
    return rows.select("doc_id", part.alias("part")).where("length(part) >= 100")


def checkpoints(log: DataFrame) -> DataFrame:
    """(session_id, content, tags) of each session: its first three contents and first five tags.

    Both are found by top-k windows, which are limited before the shuffle; a session of any size is no burden.
    Rows without a session are left out.
    """
    rows = log.where("session_id is not null and session_id <> '' and line_num is not null")
    first = Window.partitionBy("session_id").orderBy("line_num")
    three = rows.select("session_id", "line_num", F.substring(T.text(F.col("content")), 1, 100).alias("part")).withColumn("n", F.row_number().over(first)).where("n <= 3")
    text = three.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts"))
    tags = rows.select("session_id", "line_num", F.posexplode("tags").alias("at", "tag")).where(F.col("tag").isNotNull() & ~F.lower("tag").isin(CHECKPOINT_SKIPPED_TAGS))
    tags = tags.groupBy("session_id", "tag").agg(F.min(F.struct("line_num", "at")).alias("seen"))
    early = Window.partitionBy("session_id").orderBy("seen", "tag")
    five = tags.withColumn("n", F.row_number().over(early)).where("n <= 5").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "tag"))).alias("tags"))
    content = F.substring(F.concat(F.lit("Session "), F.substring("session_id", 1, 8), F.lit(": "), F.expr("array_join(transform(parts, p -> p.part), ' | ')")), 1, 500)
    names = F.expr("array_join(concat(array('session_checkpoint'), coalesce(transform(tags, t -> t.tag), cast(array() as array<string>))), ',')")
    return text.join(five, "session_id", "left").select("session_id", content.alias("content"), names.alias("tags"))


def last_session(log: DataFrame, sessions: DataFrame, most: int = 250) -> DataFrame:
    """(session_id, summary): for each asking session, the newest checkpoint of another one, else the topics of the
    latest other session's last block of rows, else its first snippets.

    The sessions compare by their first eight characters.  Only the newest two checkpoints and the newest rows of
    the last three sessions can matter, so the log is reduced to these before it meets the sessions.  For a summary of
    the last 4,096 bytes only, give readers.tail() of the log.
    """
    rows = log.where("line_num is not null and session_id is not null and session_id <> 'unknown'").select("line_num", F.substring("session_id", 1, 8).alias("sid"), "type", T.text(F.col("content")).alias("content"), "tags")
    asking = sessions.select("session_id").distinct().withColumn("own", F.substring(F.coalesce("session_id", F.lit("")), 1, 8))
    newest = rows.where("type = 'SESSION_CHECKPOINT'").groupBy("sid").agg(F.max(F.struct("line_num", "content")).alias("last"))
    two = newest.orderBy(F.desc("last")).limit(2).agg(F.array_sort(F.collect_list(F.struct(F.col("last.line_num").alias("line"), "sid", F.col("last.content").alias("content"))), lambda a, b: F.when(a["line"] > b["line"], -1).otherwise(1)).alias("two"))
    heads = rows.groupBy("sid").agg(F.max("line_num").alias("line")).orderBy(F.desc("line"), "sid").limit(3).agg(F.array_sort(F.collect_list(F.struct((-F.col("line")).alias("back"), "sid", "line"))).alias("heads"))
    picked = asking.withColumn("two", two.select("two").scalar()).withColumn("heads", heads.select("heads").scalar()).withColumn("blocks", _last_blocks(rows, heads).select("blocks").scalar())
    summary = F.expr("get(filter(two, x -> x.sid <> own), 0).content")
    # the walk back skips rows of the asking session and ends at the newest row of a third one
    picked = picked.withColumn("last", F.expr("if(own <=> get(heads, 0).sid, get(heads, 1).sid, get(heads, 0).sid)"))
    picked = picked.withColumn("third", F.expr("if(own <=> get(heads, 0).sid or own <=> get(heads, 1).sid, get(heads, 2).line, get(heads, 1).line)"))
    picked = picked.withColumn("block", F.expr("get(filter(blocks, b -> b.sid = last), 0)"))
    inside = "filter(block.{0}, x -> third is null or x.line > third)"
    topics_of = F.expr(f"concat('{TOPICS_HEAD}', nullif(array_join(transform({inside.format('tags')}, x -> x.tag), ', '), ''))")
    snippets = F.expr(f"concat('{SNIPPETS_HEAD}', array_join(transform({inside.format('parts')}, x -> x.part), ' | '))")
    return picked.select("session_id", F.substring(F.coalesce(summary, topics_of, snippets, F.lit("")), 1, most).alias("summary"))


def _last_blocks(rows: DataFrame, heads: DataFrame, most: int = 8) -> DataFrame:
    """(blocks) in one row: of each of the newest two sessions the last distinct tags, without the generic ones, and the last
    three contents of 40 characters, both newest first and with their lines, as far back as the third session.

    Both are top-k windows over rows combined before the shuffle; a session of any size is no burden.
    """
    recent = rows.withColumn("heads", heads.select("heads").scalar()).where("sid in (get(heads, 0).sid, get(heads, 1).sid) and coalesce(line_num > get(heads, 2).line, true)").drop("heads")
    tags = recent.select("sid", "line_num", F.posexplode("tags").alias("at", "tag")).where(F.col("tag").isNotNull() & ~F.lower("tag").isin(SUMMARY_SKIPPED_TAGS))
    seen = tags.groupBy("sid", "tag").agg(F.max(F.struct("line_num", -F.col("at"))).alias("seen"))
    late = Window.partitionBy("sid").orderBy(F.desc("seen"), "tag")
    top = seen.withColumn("n", F.row_number().over(late)).where(F.col("n") <= most).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("n", "tag", F.col("seen.line_num").alias("line")))).alias("tags"))
    last = Window.partitionBy("sid").orderBy(F.desc("line_num"), "content")
    three = recent.select("sid", "line_num", F.substring("content", 1, 40).alias("content")).withColumn("n", F.row_number().over(last)).where("n <= 3").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("n", F.col("content").alias("part"), F.col("line_num").alias("line")))).alias("parts"))
    return three.join(top, "sid", "left").agg(F.collect_list(F.struct("sid", "tags", "parts")).alias("blocks"))


def topics(log: DataFrame, most: int = 8) -> DataFrame:
    """(session_id, summary) of every session by its tags in reverse row order, without the generic ones, or, where it has
    none, by its last three contents of 40 characters: what the summary falls back to without a checkpoint."""
    rows = log.where("session_id is not null and session_id not in ('', 'unknown') and line_num is not null")
    tags = rows.select("session_id", "line_num", F.posexplode("tags").alias("at", "tag")).where(F.col("tag").isNotNull() & ~F.lower("tag").isin(SUMMARY_SKIPPED_TAGS))
    seen = tags.groupBy("session_id", "tag").agg(F.max(F.struct("line_num", -F.col("at"))).alias("seen"))
    late = Window.partitionBy("session_id").orderBy(F.desc("seen"), "tag")
    top = seen.withColumn("n", F.row_number().over(late)).where(F.col("n") <= most).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "tag"))).alias("tags"))
    last = Window.partitionBy("session_id").orderBy(F.desc("line_num"))
    three = rows.select("session_id", "line_num", F.substring(T.text(F.col("content")), 1, 40).alias("part")).withColumn("n", F.row_number().over(last)).where("n <= 3").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts"))
    text = F.coalesce(F.expr(f"concat('{TOPICS_HEAD}', array_join(transform(tags, t -> t.tag), ', '))"), F.expr(f"concat('{SNIPPETS_HEAD}', array_join(transform(parts, p -> p.part), ' | '))"))
    return three.join(top, "session_id", "left").select("session_id", F.substring(text, 1, 250).alias("summary"))


LEARNING = "content string, type string, tags array<string>"


def validated(responses: DataFrame, most: int = 5) -> DataFrame:
    """(id, at, type, content, tags) of the learnings in JSON responses (id, response): an object or an array of objects, maybe
    in a code fence; what does not parse gives nothing.  At most `most` for a response."""
    raw = T.strip(F.regexp_replace(T.strip(F.col("response")), r"^```(?:json)?|```$", ""))
    many = F.from_json(F.when(F.startswith(raw, F.lit("[")), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), f"array<struct<{LEARNING.replace(' string', ': string').replace(' array', ': array')}>>")
    rows = responses.where("id is not null and response is not null").select("id", F.posexplode(many).alias("at", "item")).select("id", "at", T.strip(F.col("item.content")).alias("content"), T.strip(F.col("item.type")).alias("type"), F.col("item.tags").alias("tags"))
    rows = rows.where("length(content) >= 20")
    order = Window.partitionBy("id").orderBy("at")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    tags = F.slice(F.filter(F.transform(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.lower(T.strip(t))), lambda t: F.length(t) >= 2), 1, 8)
    return rows.select("id", "at", F.when(F.col("type").isin(VALID_TYPES), F.col("type")).otherwise("WORKING_SOLUTION").alias("type"), F.substring("content", 1, 500).alias("content"), F.array_join(tags, ",").alias("tags"))


def stats(log: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(log_entries, last_entry_date, memory_lines): rows, the last time in file order that is not empty, and the lines of core
    memory (text, n_lines), 0 without."""
    last = F.max_by("logged_at", F.when(F.coalesce(F.col("logged_at"), F.lit("")) != "", F.col("line_num")))
    out = log.agg(F.count("*").alias("log_entries"), last.alias("last_entry_date"))
    lines = F.lit(0) if memory is None else F.coalesce(memory.agg(F.sum("n_lines").cast("int").alias("n")).select("n").scalar(), F.lit(0))
    return out.withColumn("memory_lines", lines)
