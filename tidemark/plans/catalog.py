"""Registered queries over the driver's tables.

Every query runs over whole tables.  The read path in full (assembled_context, ack_markers) and decisions_new ask for every document;
the other searches take as queries the rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions import text as T
from tidemark.operators import cache, capture, completion, corpus, dedup, events, inject, score, search
from tidemark.operators.staging import new_folder, staged
from tidemark.plans import context
from tidemark.plans.oracle import oracle_sql as _oracle
from tidemark.sources import readers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(s, d):
    return table(s, d, "memory_log")


def _core(s, d):
    return table(s, d, "core_tagged")


def _indexes(s, d):
    return search.opened(s, f"{d}/memory_log.parquet", f"{d}/core_tagged.parquet", table(s, d, "aliases"))


def _all_prompts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("prompt"), "session_id")


def _prompts(s, d):
    return _all_prompts(s, d).where("query_id % 100 = 0")


def _intents(s, d):
    return inject.admitted(_prompts(s, d)).select("query_id", F.col("intent").alias("text"))


def _asking(s, d, start: int | None = None):
    """Log entries as queries."""
    c = F.col("content") if start is None else F.substring("content", 1, start)
    return _log(s, d).where("line_num % 100 = 0 and content is not null").select(F.col("line_num").alias("query_id"), c.alias("text"))


def idf_stats(s, d):
    return corpus.idf(corpus.log_entries(_log(s, d)), corpus.core_entries(_core(s, d))).select("token", "df", F.round("weight", 6).alias("weight"))


def token_postings(s, d):
    return corpus.postings(corpus.surfacing(corpus.log_entries(_log(s, d))))


def vocab_stems(s, d):
    return corpus.vocabulary(corpus.log_entries(_log(s, d)))


def soundex_codes(s, d):
    return corpus.vocabulary(corpus.log_entries(_log(s, d))).select("token", T.soundex(F.col("token")).alias("code"))


def quality_gate(s, d):
    return _log(s, d).select("line_num", T.worth_surfacing(F.col("content")).alias("surfacing"), T.worth_storing(F.col("content")).alias("storing"))


def content_hashes(s, d):
    return _log(s, d).where("content is not null").select("line_num", T.content_hash(F.col("content")).alias("hash"))


def decay_curve(s, d):
    age = T.age_days(T.iso_time(F.col("logged_at")), DEFAULT.now)
    return _log(s, d).select("line_num", F.round(age * 86400).cast("long").alias("age_seconds"), F.round(F.exp(-DEFAULT.decay_rate * age), 6).alias("decay"))


def query_token_topk(s, d):
    log, _ = _indexes(s, d)
    return search.tokens_of(_intents(s, d), log).select("query_id", "token", F.round("weight", 6).alias("weight"))


def partial_matches(s, d):
    log, _ = _indexes(s, d)
    return score.partial_matches(search.tokens_of(_intents(s, d), log), log.vocabulary)


def search_prefilter_candidates(s, d):
    log, _ = _indexes(s, d)
    return search.prefiltered(_intents(s, d), log)


_PICK = ["query_id", "entry_id", "score", "rank"]


def search_exact_topk(s, d):
    log, _ = _indexes(s, d)
    return search.search(_intents(s, d), log, only_exact=True).select(*_PICK)


def search_log_topk(s, d):
    log, _ = _indexes(s, d)
    return search.search(_intents(s, d), log).select(*_PICK, "match", "n_exact")


def search_cached_topk(s, d):
    log, _ = _indexes(s, d)
    return search.search(_intents(s, d), log, cached=True).select(*_PICK, "match", "n_exact")


def search_core_topk(s, d):
    _, core = _indexes(s, d)
    return search.search(_intents(s, d), core).select(*_PICK)


def two_pass_rescore(s, d):
    log, _ = _indexes(s, d)
    texts = _intents(s, d)
    return search.rescored(search.search(texts, log, 20), texts, log)


def expanded_recall(s, d):
    log, _ = _indexes(s, d)
    texts = _intents(s, d)
    return search.search(search.expanded(texts, search.alias_expansions(texts, log.aliases)), log).select(*_PICK)


def exact_match_counts(s, d):
    log, _ = _indexes(s, d)
    texts = _intents(s, d)
    return search.exact_counts(search.search(texts, log), texts, log.entries).select("query_id", "entry_id", "exact_matches")


def _path(s, d, prompts=None):
    log, core = _indexes(s, d)
    return context.read_path(_prompts(s, d) if prompts is None else prompts, log, core)


def fused_merge_topk(s, d):
    return _path(s, d).fused.select(*_PICK, "exact_matches")


def tiered_results(s, d):
    return _path(s, d).tiers.select("query_id", "entry_id", "tier", "rank")


def cluster_merge(s, d):
    return _path(s, d).clusters.select("query_id", "place", "entry_id", "related", "content")


def budgeted_context(s, d):
    return _path(s, d).block


def core_context(s, d):
    return _path(s, d).core_block


def assembled_context(s, d):
    log, core = _indexes(s, d)
    prompts = _all_prompts(s, d)
    summaries = capture.last_session(_log(s, d), prompts)
    return context.assembled(context.read_path(prompts, log, core, summaries), summaries)


def ack_markers(s, d):
    path = _path(s, d, _all_prompts(s, d))
    return inject.ack_markers(path.clusters, path.prompts)


def ack_current(s, d):
    """One marker for each session: a later prompt takes the place of an earlier one."""
    path = _path(s, d)
    return inject.current_markers(inject.ack_markers(path.clusters, path.prompts).withColumn("version", F.col("query_id"))).select("session_id", "query_id", "count", "intent")


def gate_first_block(s, d):
    """Errors set a marker for their user; the first event within the time to live is blocked."""
    e = table(s, d, "events").where("ts is not null and user_id is not null").select("event_id", F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    markers = e.where("event_type = 'error'").select("session_id", F.col("ts").alias("created_at"), F.lit(1).cast("long").alias("count"))
    return inject.gate(markers, e.where("event_type <> 'error'")).select("session_id", "event_id")


def prompt_filter(s, d):
    return inject.admitted(_all_prompts(s, d)).select("query_id")


def intent_extraction(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.intent(F.col("text")).alias("intent"))


def dedup_exact_hash(s, d):
    return dedup.hash_duplicates(_log(s, d))


def dedup_decision(s, d):
    return dedup.tail_decisions(_log(s, d))


def dedup_summary(s, d):
    return dedup.tail_decisions(_log(s, d)).groupBy("decision").agg(F.count("*").alias("n"))


def superseded_log(s, d):
    return dedup.superseded(_log(s, d), dedup.tail_decisions(_log(s, d)))


def near_dup_pairs(s, d):
    return dedup.near_pairs(_log(s, d))


def near_dup_members(s, d):
    """Every row of the log with words and its class of equal word sets, the classes near_dup_pairs links."""
    return dedup.near_classes(_log(s, d))[0]


def dup_by_search(s, d):
    log, _ = _indexes(s, d)
    return search.search(_asking(s, d, 80), log, 1).where(F.col("score") > DEFAULT.same).select("query_id", "entry_id", "score")


def repetition_check(s, d):
    log, _ = _indexes(s, d)
    return capture.repetition(_asking(s, d), log)


def store_stats(s, d):
    """With the lines of core memory, of which the alias keys stand for a text file."""
    folder = new_folder(s, "memory")
    table(s, d, "aliases").select("alias_key").coalesce(1).write.text(folder)
    return capture.stats(_log(s, d), readers.core_memory(s, folder))


def tail_scan(s, d):
    return readers.tail(_log(s, d).select("line_num", F.coalesce("content", F.lit("")).alias("line")), "line_num", DEFAULT.tail_bytes).select("line_num")


def jsonl_entries(s, d):
    lines = table(s, d, "entry_cache").select("line_num", F.col("raw_json").alias("line"))
    e = readers.parsed_entries(lines)
    return e.select("line_num", "type", "content", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|", "").alias("tags"), "session_id")


def core_jsonl_scan(s, d):
    """Curated entries written as JSON lines and read back."""
    folder = new_folder(s, "core-jsonl")
    readers.append(_core(s, d).select("section", "content", "tags", "priority", "type"), folder)
    return readers.core_tagged(s, folder).select("section", "content", _joined_tags(), "priority", "type")


def _joined_tags():
    return F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|", "").alias("tags")


def jsonl_append_scan(s, d):
    """The log appended to JSON lines in two parts and read back."""
    folder = new_folder(s, "log-jsonl")
    log = _log(s, d)
    for part in ("line_num % 2 = 0", "line_num % 2 <> 0"):
        readers.append(log.where(part).select("type", "content", "tags", F.col("logged_at").alias("timestamp"), "session_id", "source"), folder)
    return readers.memory_log(s, folder).select("type", "content", _joined_tags(), "logged_at", "session_id", "source")


def alias_load(s, d):
    """Aliases written as one JSON object and read back."""
    folder = new_folder(s, "aliases")
    one = table(s, d, "aliases").where("alias_key is not null and expansions is not null").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("alias_key", "expansions")))).alias("value"))
    one.coalesce(1).write.text(folder)
    return readers.aliases(s, folder).select("alias_key", F.array_join("expansions", "|", "").alias("expansions"))


def transcript_json(s, d):
    """Transcripts as JSON lines in both layouts: what users say in the one, what others say in the other."""
    docs = table(s, d, "documents").where("kind = 'transcript' and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "said"))
    user = F.startswith(F.col("said"), F.lit("[USER] "))
    plain = F.to_json(F.struct(F.lit("user").alias("role"), F.substring("said", 8, 1_000_000).alias("content")))
    block = F.struct(F.lit("text").alias("type"), F.col("said").alias("text"))
    other = F.struct(F.lit("tool_use").alias("type"), F.lit("hidden").alias("text"))
    nested = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.lit("assistant").alias("role"), F.array(block, other).alias("content")).alias("message")))
    return readers.transcript_messages(docs.select("doc_id", "pos", F.when(user, plain).otherwise(nested).alias("line")))


def completion_keys(s, d):
    return _log(s, d).where("content is not null").select("line_num", completion.cache_key(F.col("content")).alias("prompt_key"), completion.verdict_key(F.col("content")).alias("verdict_key"))


def completion_memo(s, d):
    """Answers from a memo table that knows the contents of even lines."""
    prompts = _log(s, d).where("line_num is not null").select(F.col("line_num").alias("id"), F.col("content").alias("prompt"))
    memo = prompts.where("id % 2 = 0 and prompt is not null").select(completion.cache_key(F.col("prompt")).alias("key"), F.upper(F.substring("prompt", 1, 20)).alias("response")).distinct()
    return completion.complete(prompts, memo.groupBy("key").agg(F.min("response").alias("response"))).select("id", "key", "response")


def entry_cache_synced(s, d):
    """The cache built over the first half of the log and synced with all of it; entries appended; then synced once more."""
    folder, log = new_folder(s, "cache"), _log(s, d).where("line_num is not null")
    half, most = log.agg(F.percentile_approx("line_num", 0.5, 1000), F.max("line_num")).first()
    cache.sync(log.where(F.col("line_num") <= half), folder)
    cache.sync(log.where(F.col("line_num") < most), folder)
    cache.append_inline(log.where(F.col("line_num") == most), log, folder)
    return cache.sync(log, folder)


def entry_cache_dirty(s, d):
    """The cache of another log, marked dirty, and synced."""
    folder, log = new_folder(s, "cache"), _log(s, d)
    cache.sync(log.withColumn("content", F.reverse("content")), folder)
    cache.mark_dirty(s, folder)
    return cache.sync(log, folder)


def idf_kept(s, d):
    """Word weights kept from a log without its last 40 lines, used again for the whole log; and those that must be counted again
    because 60 lines or a day have gone by."""
    log, core = corpus.log_entries(_log(s, d)), corpus.core_entries(_core(s, d))
    out = None
    for mode, missing, hour in (("kept", 40, 10), ("grown", 60, 10), ("aged", 40, 40)):
        folder = new_folder(s, "idf")
        last = log.orderBy(F.desc("entry_id")).limit(missing).agg(F.min("entry_id")).first()[0]
        cache.idf_at(folder, "2026-11-01T00:00:00Z", log.where(F.col("entry_id") < last), core)
        rows = cache.idf_at(folder, f"2026-11-{1 + hour // 24:02d}T{hour % 24:02d}:00:00Z", log, core).select(F.lit(mode).alias("mode"), "token", F.round("weight", 6).alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def entry_cache_build(s, d):
    return cache.prepared(_log(s, d))


def cache_staleness(s, d):
    log = _log(s, d).select("line_num", T.content_hash(F.col("content")).alias("now_hash"))
    cache = table(s, d, "entry_cache").select("line_num", "content_hash")
    state = F.expr("case when content_hash is null and cached is null then 'missing' when content_hash is null then 'unhashed' when content_hash = now_hash then 'fresh' else 'stale' end")
    return log.join(cache.withColumn("cached", F.lit(True)), "line_num", "left").select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def idf_staleness(s, d):
    now = corpus.idf(corpus.log_entries(_log(s, d)), corpus.core_entries(_core(s, d)))
    old = table(s, d, "idf_weights").select("token", F.col("weight").alias("old_weight"))
    return now.join(old, "token", "full_outer").select("token", F.round("weight", 6).alias("weight"), F.round("old_weight", 6).alias("old_weight"), F.coalesce(F.abs(F.col("weight") - F.col("old_weight")) > 0.01, F.lit(True)).alias("stale"))


def transcript_lines(s, d):
    """Transcripts from documents: lines of a user stand behind [USER]."""
    docs = table(s, d, "documents").where("kind = 'transcript' and text is not null").select("doc_id", "text")
    return readers.transcript_tail(docs, 200)


def session_summary(s, d):
    return capture.last_session(_log(s, d), table(s, d, "documents").select("session_id"))


def session_summary_tail(s, d):
    """The same from the last 4,096 bytes of the log alone."""
    log = readers.tail(_log(s, d).withColumn("line", F.coalesce("content", F.lit(""))), "line_num", 4096).drop("line")
    return capture.last_session(log, table(s, d, "documents").select("session_id"))


def session_topics(s, d):
    return capture.topics(_log(s, d))


def session_checkpoints(s, d):
    return capture.checkpoints(_log(s, d))


def _as_prompts(s, d):
    return _log(s, d).where("line_num is not null").select(F.col("line_num").alias("query_id"), F.col("content").alias("prompt"))


def corrections_extracted(s, d):
    return capture.corrections(_as_prompts(s, d)).select("query_id", "type", "content")


def correction_gate(s, d):
    return _as_prompts(s, d).where("prompt is not null").select("query_id", capture.has_signals(F.col("prompt")).alias("signals"), capture.weak_signals(F.col("prompt")).alias("weak"))


def correction_pipeline(s, d):
    log, _ = _indexes(s, d)
    return capture.pipeline(_as_prompts(s, d), log, _log(s, d))


def smart_tags(s, d):
    return capture.corrections(_as_prompts(s, d)).select("query_id", F.array_join(T.smart_tags(F.col("content"), F.col("full_prompt")), ",").alias("tags"))


def decisions_extracted(s, d):
    return capture.decisions(table(s, d, "documents"))


def decisions_new(s, d):
    """Decisions the log does not know yet: a search for each."""
    log, _ = _indexes(s, d)
    return capture.new_decisions(table(s, d, "documents"), log)


def plan_reasoning(s, d):
    """Plans with a heading before their text and a reason at its end."""
    plans = table(s, d, "documents").where("kind = 'plan' and text is not null")
    text = F.concat(F.lit("# Plan\n## Why now\n"), "text", F.lit("\n## Steps\nChose item "), F.col("doc_id").cast("string"), F.lit(" because "), F.regexp_replace(F.substring("text", 1, 200), r"[^a-zA-Z0-9 ]", "x"), F.lit(" and so on"))
    return capture.plan_reasoning(plans.select("doc_id", text.alias("text")))


def incremental_tail(s, d):
    docs = table(s, d, "documents")
    return capture.incremental(docs, docs.select("doc_id", F.expr("n_chars div 2").alias("offset")))


def validate_learnings(s, d):
    return capture.validated(table(s, d, "entry_cache").select(F.col("line_num").alias("id"), F.col("raw_json").alias("response"))).select("id", "type", "content", "tags")


def _calls(s, d):
    return events.from_events(table(s, d, "events"))


def _acts(s, d):
    return events.activities(_calls(s, d))


def activities(s, d):
    return _acts(s, d).select("event_id", "session_id", "category", "description")


def activity_summary(s, d):
    return events.summaries(_acts(s, d))


def error_resolution(s, d):
    return events.resolutions(_acts(s, d))


def error_resolution_any(s, d):
    """Resolutions whoever caused them: one stream, cut into hours that are independent but for the 300 seconds after."""
    return events.resolutions_by_anyone(_acts(s, d), DEFAULT.fix_seconds)


def test_results(s, d):
    return events.test_results(_by_hour(_calls(s, d)))


def _by_hour(calls):
    """Calls of all users as sessions of an hour, dense enough for windows of five minutes."""
    return calls.withColumn("session_id", F.date_format("ts", "yyyy-MM-dd-HH"))


def test_failures_new(s, d):
    """What is stored of failed tests the log has nothing similar to."""
    log, _ = _indexes(s, d)
    rows = staged(events.test_learnings(events.test_results(_by_hour(_calls(s, d)))).where("type = 'FAILED_APPROACH'"), "failures")
    return rows.join(search.unknown(rows.select(F.col("event_id").alias("query_id"), F.col("content").alias("text")), log).withColumnRenamed("query_id", "event_id"), "event_id").select("event_id", "content")


def error_resolution_hourly(s, d):
    """Resolutions in sessions of an hour."""
    return events.resolutions(events.activities(_by_hour(_calls(s, d))))


def signal_retry_success(s, d):
    return events.retry_success(_acts(s, d))


def signal_config_breakthrough(s, d):
    return events.config_breakthrough(_acts(s, d))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled_context(spark, sf_dir)


_NAMES = """idf_stats token_postings vocab_stems soundex_codes quality_gate content_hashes decay_curve query_token_topk partial_matches
search_prefilter_candidates search_exact_topk search_log_topk search_cached_topk search_core_topk two_pass_rescore expanded_recall exact_match_counts
fused_merge_topk tiered_results cluster_merge budgeted_context core_context assembled_context ack_markers ack_current gate_first_block
prompt_filter intent_extraction dedup_exact_hash dedup_decision dedup_summary superseded_log near_dup_pairs near_dup_members dup_by_search
repetition_check store_stats tail_scan jsonl_entries entry_cache_build entry_cache_synced entry_cache_dirty idf_kept core_jsonl_scan jsonl_append_scan alias_load transcript_json completion_keys completion_memo cache_staleness idf_staleness transcript_lines session_summary session_summary_tail session_topics
session_checkpoints corrections_extracted correction_gate correction_pipeline smart_tags decisions_extracted decisions_new plan_reasoning
incremental_tail validate_learnings activities activity_summary error_resolution error_resolution_any error_resolution_hourly test_results test_failures_new
signal_retry_success signal_config_breakthrough""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    return _oracle()
