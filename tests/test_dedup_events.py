import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.fixed import SUMMARY_SKIPPED_TAGS
from tidemark.operators import capture, dedup, events
from tidemark.operators.completion import complete
from tidemark.operators.order import positions
from tidemark.plans import catalog
from tidemark.sources import readers
from tidemark.streaming import stateful
from tidemark.streaming.ingest import Ingest

LOG = "line_num long, content string"


def test_decisions(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [
        (1, base), (2, base.upper()), (3, base + " eleven"), (4, "one two three four five six a b c d e longer indeed than"), (5, ""), (6, None), (7, "quite different text"), (8, base),
    ]
    got = {r["line_num"]: (r["decision"], r["target"]) for r in dedup.tail_decisions(spark.createDataFrame(rows, LOG)).collect()}
    assert got[1] == ("APPEND", None) and got[2] == ("SKIP", None) and got[3] == ("SKIP", None)
    assert got[4] == ("SUPERSEDE", 3) and got[5] == got[6] == got[7] == ("APPEND", None) and got[8] == ("SKIP", None)
    assert dedup.tail_decisions(spark.createDataFrame([], LOG)).count() == 0


def test_near_pairs_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("a b c d e f g h i j".split(), k=rnd.randint(1, 8)))) for i in range(80)]
    sets = {}
    for i, c in rows:
        sets.setdefault(frozenset(c.split()), i)
    want = {(min(a, b), max(a, b)) for x, a in sets.items() for y, b in sets.items() if a < b and 2 * len(x & y) > len(x | y)}
    assert {(r["id_a"], r["id_b"]) for r in dedup.near_pairs(spark.createDataFrame(rows, LOG)).collect()} == want


def test_positions(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long").repartition(5)
    assert all(r["k"] == r["pos"] for r in positions(rows, "k").collect())


def test_corrections(spark):
    rows = [
        (1, "No, use the long parser for this file please"), (2, "nothing to see"), (3, None), (4, "Use the staging queue instead of the main one today"),
        (5, "Always " + "a" * 50 + ". " + "b" * 100),
    ]
    got = {r["query_id"]: (r["type"], r["content"]) for r in capture.corrections(spark.createDataFrame(rows, "query_id long, prompt string")).collect()}
    assert got[1] == ("USER_CORRECTION", "the long parser for this file please")
    assert set(got) == {1, 4, 5} and got[5] == ("USER_PREFERENCE", "a" * 50 + ".")


def test_decision_patterns_and_plans(spark):
    text = "We decided to rewrite the loader because it blocked all writers.\nWe decided to rewrite the loader because it blocked all writers.\nfailed badly"
    rows = capture.decisions(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["place"], r["type"]) for r in rows] == [(1, 1, "ARCHITECTURAL_DECISION")]
    plan = "# Plan\n## Why\nThe loader blocks all writers for minutes at a time, so it has to go.\n## Next\nnothing\n"
    got = capture.plan_reasoning(spark.createDataFrame([(1, plan), (2, None)], "doc_id long, text string")).collect()
    assert [r["content"] for r in got] == ["The loader blocks all writers for minutes at a time, so it has to go."]


def test_validated(spark):
    good = {"content": "A learning of more than twenty characters", "type": "odd", "tags": [" Abc ", "x", None, "def"]}
    rows = [(1, json.dumps(good)), (2, "```json\n" + json.dumps([good] * 7) + "\n```"), (3, "no json"), (4, None), (5, json.dumps({"content": "short"}))]
    got = capture.validated(spark.createDataFrame(rows, "id long, response string")).collect()
    assert sorted(r["id"] for r in got) == [1] + [2] * 5
    assert {(r["type"], r["tags"]) for r in got} == {("WORKING_SOLUTION", "abc,def")}


CALLS = "event_id long, session_id string, at string, tool_name string, file_path string, old_string string, new_string string, command string, output string, exit_code int"


def calls(spark, rows):
    return spark.createDataFrame(rows, CALLS).withColumn("ts", F.to_timestamp("at"))


def bash(i, at, code, command="make all targets now", s="s"):
    return (i, s, f"2026-01-01 00:{at}", "Bash", None, None, None, command, "Error: step failed badly" if code else "3 passed", code)


def edit(i, at, s="s"):
    return (i, s, f"2026-01-01 00:{at}", "Edit", "src/a_long_name.py", "x", "y", None, None, None)


def test_resolutions_at_the_horizon(spark):
    acts = events.activities(calls(spark, [bash(1, "00:00", 1), edit(2, "05:00"), bash(3, "10:00", 1), edit(4, "15:01"), (5, "s", "2026-01-01 00:16:00", "Read", None, None, None, None, None, None)]))
    assert [(r["event_id"], r["fixed_by"]) for r in events.resolutions(acts).collect()] == [(1, 2)]
    assert acts.count() == 4


def test_test_results(spark):
    rows = [edit(1, "00:00"), bash(2, "04:59", 0, "pytest"), bash(3, "05:00", 0, "pytest"), edit(4, "06:00"), bash(5, "06:01", 1, "go test"), bash(6, "06:02", None, "jest", "t")]
    assert {(r["event_id"], r["result"]) for r in events.test_results(calls(spark, rows)).collect()} == {(2, "pass"), (5, "fail")}


def test_a_pass_clears_the_edits_before_it(spark):
    silent = (6, "s", "2026-01-01 00:03:00", "Bash", None, None, None, "pytest", " \n", 1)
    rows = [edit(1, "00:00"), bash(2, "00:10", 0, "pytest"), bash(3, "00:20", 1, "pytest"), edit(4, "00:30"), bash(5, "00:40", 1, "pytest"), silent]
    got = events.test_results(calls(spark, rows))
    assert {(r["event_id"], r["result"], r["n_edits"]) for r in got.collect()} == {(2, "pass", 1), (5, "fail", 1)}
    texts = {r["event_id"]: r["content"] for r in events.test_learnings(got).collect()}
    assert texts[5] == "Tests FAILED after editing: a_long_name.py. Changes: a_long_name.py: x -> y. Failure output: Error: step failed badly"


def test_signals(spark):
    rows = [bash(1, "00:01", 1), bash(2, "00:02", 1), bash(3, "00:03", 0), bash(4, "00:04", 0), bash(5, "00:01", 1, "pip install it", "t"), edit(6, "00:02", "t"), bash(7, "00:03", 0, s="t")]
    acts = events.activities(calls(spark, rows))
    assert [(r["session_id"], r["event_id"]) for r in events.retry_success(acts).collect()] == [("s", 3)]
    assert [(r["session_id"], r["event_id"]) for r in events.config_breakthrough(acts).collect()] == [("t", 7)]


def test_readers(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type": "A", "content": "é", "tags": ["x"], "timestamp": "2026-01-01T00:00:00Z"}\n\n{"broken\n{"type": "B", "session_id": "s"}\n', encoding="utf-8")
    rows = readers.memory_log(spark, str(tmp_path / "log.jsonl")).orderBy("line_num").collect()
    assert [(r["line_num"], r["type"], r["session_id"]) for r in rows] == [(1, "A", "unknown"), (3, "B", "s")]
    (tmp_path / "aliases.json").write_text('{"k8s": ["kubernetes"]}')
    assert readers.aliases(spark, str(tmp_path / "aliases.json")).first()["expansions"] == ["kubernetes"]
    (tmp_path / "plan.md").write_text("x" * 120)
    assert [r["stem"] for r in readers.plan_files(spark, str(tmp_path)).collect()] == ["plan"]
    (tmp_path / "MEMORY.md").write_text("a\nb\n")
    assert readers.core_memory(spark, str(tmp_path / "MEMORY.md")).first()["n_lines"] == 2


def test_transcript_of_a_session_or_the_newest(spark, tmp_path):
    import os

    folder = tmp_path / "projects" / "p"
    folder.mkdir(parents=True)
    (folder / "old.jsonl").write_text("\n".join(json.dumps({"role": "user", "content": f"old {i}"}) for i in range(250)))
    (folder / "new.jsonl").write_text(json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}]}}) + "\n" + json.dumps({"role": "user", "content": "there"}) + "\n")
    os.utime(folder / "old.jsonl", (1, 1))
    root = f"file://{tmp_path}/projects"
    assert readers.transcript(spark, root).first()["text"] == "hi\n[USER] there"
    said = readers.transcript(spark, root, "old").first()["text"].split("\n")
    assert len(said) == 200 and said[-1] == "[USER] old 249"
    assert len(readers.transcript(spark, root, "old", max_bytes=100).first()["text"].split("\n")) == 2


def test_observations_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01", ["p"], "seen", None), ("2026-01-02", None, None, "s")], "date string, project_tags array<string>, content string, session_id string")
    for _ in range(2):
        readers.append_observations(rows, str(tmp_path / "observations"))
    got = spark.read.text(str(tmp_path / "observations")).collect()
    assert [json.loads(r[0]) for r in got] == [{"date": "2026-01-01", "project_tags": ["p"], "content": "seen"}] * 2


def test_pipeline_log(spark, tmp_path):
    from tidemark.streaming.progress import ProgressLog, pipeline_log

    log = ProgressLog(pipeline_log(str(tmp_path / "pipeline.log")))
    spark.streams.addListener(log)
    spark.range(3).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    log._say("done", rows=3)
    spark.streams.removeListener(log)
    assert "done" in (tmp_path / "pipeline.log").read_text()
    ProgressLog(pipeline_log(str(tmp_path / "missing" / "x.log")))._say("lost")


def test_snapshot_decisions(spark):
    log = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "alpha beta gamma delta"), (3, None), (4, "")], LOG)
    new = [(1, "ONE two three four five six seven eight nine ten"), (2, "one two three four five six a b c d e and something longer"), (3, ""), (4, None), (5, "alpha beta gamma delta epsilon"), (6, "something else"), (None, "x")]
    got = {r["id"]: (r["decision"], r["target"]) for r in dedup.snapshot_decisions(spark.createDataFrame(new, "id long, content string"), log).collect()}
    assert got == {1: ("SKIP", None), 2: ("SUPERSEDE", 1), 3: ("APPEND", None), 4: ("APPEND", None), 5: ("SKIP", None), 6: ("APPEND", None)}
    assert dedup.snapshot_decisions(spark.createDataFrame(new, "id long, content string"), log.limit(0)).where("decision = 'APPEND'").count() == 6


@pytest.mark.parametrize("seed", range(3))
def test_decisions_of_a_long_log(spark, seed, monkeypatch):
    from tidemark.config import DEFAULT

    monkeypatch.setattr(dedup, "BLOCK", 64)  # tails cross blocks
    rnd = random.Random(seed)
    rows = [(i * 3, " ".join(rnd.choices("abcdefghij", k=rnd.choice([0, 3, 6, 9, 300]))) if rnd.random() > 0.05 else None) for i in range(400)]
    want, tail, hashes = {}, dedup.Tail(DEFAULT), set()
    for line, content in rows:
        c = content or ""
        words = frozenset(c.split())
        same, old = tail.compare(len(c), c[:80], words) if c else (False, None)
        want[line] = "SKIP" if c and (same or c in hashes) else "SUPERSEDE" if old else "APPEND"
        tail.add(line, len(c) + 1, len(c), c[:80], words)
        if content is not None:
            hashes.add(c)
    got = {r["line_num"]: r["decision"] for r in dedup.tail_decisions(spark.createDataFrame(rows, LOG)).collect()}
    assert got == want


def test_tail_scan(spark):
    rows = spark.createDataFrame([(i, "x" * 9) for i in range(1, 21)], "line_num long, line string")
    assert sorted(r["line_num"] for r in readers.tail(rows, "line_num", 31).collect()) == [18, 19, 20]


def test_transcripts(spark):
    rows = [
        (1, 0, '{"role": "user", "content": "hello"}'), (1, 1, '{"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "b"}]}}'),
        (1, 2, '{"role": "system", "content": "no"}'), (1, 3, "broken"),
    ]
    got = readers.transcript_messages(spark.createDataFrame(rows, "doc_id long, pos int, line string")).orderBy("pos").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "hello"), ("assistant", "a")]


def test_replace_lines(spark, tmp_path):
    path = str(tmp_path / "versions")
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "line_num long, content string, version long").write.parquet(path)
    now = readers.replace_lines(spark.read.parquet(path), spark.createDataFrame([(1, "c", 3)], "line_num long, content string, version long"), path)
    assert {(r["line_num"], r["content"]) for r in now.collect()} == {(1, "c"), (2, "b")}


def test_completion(spark):
    class Loud:
        def complete(self, prompt):
            if prompt == "bad":
                raise ValueError
            return prompt.upper()

    prompts = spark.createDataFrame([(1, "one"), (2, "bad"), (3, None)], "id long, prompt string")
    assert {r["response"] for r in complete(prompts).collect()} == {None}
    assert {r["id"]: r["response"] for r in complete(prompts, backend=Loud).collect()} == {1: "ONE", 2: None, 3: None}


def test_streamed_ingest_sees_its_own_decisions(spark, tmp_path):
    base = "one two three four five six seven eight nine ten"
    parts = [[("l", 1, base), ("l", 2, base.upper())], [("l", 3, base + " eleven"), ("l", 4, "something else"), ("l", 5, None)]]
    ingest = Ingest(spark, str(tmp_path / "store"))
    source = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "shard string, line_num long, content string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("shard string, line_num long, content string").parquet(str(source))
        ingest.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["line_num"] for r in ingest.current().collect()) == [1, 4, 5]


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    ingest, rows = Ingest(spark, f"file://{tmp_path}/store"), "shard string, line_num long, content string"
    first = spark.createDataFrame([("l", 1, "one two three four five"), ("l", 2, ""), ("l", 3, None), (None, 1, "one two three four five"), ("l", None, "x")], rows)
    second = spark.createDataFrame([("l", 4, "ONE two three four five"), ("l", 5, "one two three alpha beta gamma delta epsilon"), ("l", 6, "")], rows)
    for df, n in ((first, 0), (second, 1), (second, 1)):
        ingest.batch(df, n)
    got = sorted((r["shard"], r["line_num"], r["version"]) for r in ingest.current().collect())
    assert got == [("", 1, 1), ("l", 1, 5), ("l", 2, 2), ("l", 3, 3), ("l", 6, 6)]
    ingest.batch(spark.createDataFrame([("l", 7, "one two three alpha beta gamma zeta eta theta iota kappa lambda")], rows), 2)
    assert ("l", 1, 7) in {(r["shard"], r["line_num"], r["version"]) for r in ingest.current().collect()}


def test_streamed_resolutions_and_gate(spark, tmp_path):
    acts = events.activities(calls(spark, [bash(1, "00:00", 1), bash(2, "00:30", 1), edit(3, "01:00"), edit(4, "02:00"), edit(5, "03:00")]))
    acts.coalesce(1).write.parquet(str(tmp_path / "acts"))
    stream = spark.readStream.schema(acts.schema).parquet(str(tmp_path / "acts"))
    q = stateful.resolutions(stream).writeStream.format("memory").queryName("fixed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["event_id"], r["fixed_by"]) for r in spark.table("fixed").collect()} == {(1, 3), (2, 4)}

    rows = spark.createDataFrame([("s", "2026-01-01 00:00:00", 1, 1), ("s", "2026-01-01 00:01:00", 2, None), ("s", "2026-01-01 00:02:00", 3, None)], "session_id string, at string, event_id long, count long").withColumn("ts", F.to_timestamp("at")).drop("at")
    rows.coalesce(1).write.parquet(str(tmp_path / "marks"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "marks"))
    q = stateful.gate(stream).writeStream.format("memory").queryName("blocked").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["event_id"] for r in spark.table("blocked").collect()] == [2]


def test_cache_sync(spark, tmp_path):
    from tidemark.operators import cache

    schema = "line_num long, type string, content string, tags array<string>"
    rows = [(1, "A", "Deploying gateways", ["Ops team", None]), (2, None, None, None), (3, "B", "x", [])]
    path = str(tmp_path / "cache")
    assert cache.sync(spark.createDataFrame(rows[:2], schema), path).count() == 2
    got = {r["line_num"]: r for r in cache.sync(spark.createDataFrame(rows, schema), path).collect()}
    assert sorted(got) == [1, 2, 3] and got[1]["stems"] == "deplo gateway ops team" and got[1]["tag_tokens"] == "ops team"
    assert cache.sync(spark.createDataFrame(rows[:1], schema), path).count() == 1
    # a line of equal length in place of another
    cache.sync(spark.createDataFrame(rows, schema), path)
    other = [(1, "A", "Deploying gatewayz", ["Ops team", None]), *rows[1:]]
    assert "gatewayz" in cache.sync(spark.createDataFrame(other, schema), path).where("line_num = 1").first()["tokens"]
    # the next line, and one that is not
    more = [*other, (4, "C", "fourth line", None)]
    assert cache.append_inline(spark.createDataFrame(more[3:], schema), spark.createDataFrame(more, schema), path).count() == 4
    assert cache.append_inline(spark.createDataFrame(more[:1], schema), spark.createDataFrame(more, schema), path).count() == 4
    assert cache._meta(spark, path) is None and cache.sync(spark.createDataFrame(more, schema), path).count() == 4
    assert cache.sync(spark.createDataFrame([], schema), path).count() == 0


def test_last_session(spark):
    log = [(1, "a2345678-1", "SESSION_CHECKPOINT", "first", ["x"]), (2, "b2345678-1", "SESSION_CHECKPOINT", "second", None), (3, "unknown", "SESSION_CHECKPOINT", "third", None), (4, None, "SESSION_CHECKPOINT", "fourth", None)]
    log = spark.createDataFrame(log, "line_num long, session_id string, type string, content string, tags array<string>")
    asking = spark.createDataFrame([("b2345678-9",), ("c",), (None,)], "session_id string")
    assert {r["session_id"]: r["summary"] for r in capture.last_session(log, asking).collect()} == {"b2345678-9": "first", "c": "second", None: "second"}
    assert {r["summary"] for r in capture.last_session(log.limit(0), asking).collect()} == {""}
    assert {r["session_id"]: r["summary"] for r in capture.topics(log).collect()} == {"a2345678-1": "Last session topics: x", "b2345678-1": "Last session: second"}
    assert {r["session_id"] for r in capture.checkpoints(log).collect()} == {"a2345678-1", "b2345678-1", "unknown"}


def walked_back(log, own):
    """The rule itself, row by row; log: (line_num, session_id, type, content, tags) in order."""
    own = (own or "")[:8]
    others = [r for r in reversed(log) if r[1] is not None and r[1] != "unknown" and r[1][:8] != own]
    for r in others:
        if r[2] == "SESSION_CHECKPOINT":
            return (r[3] or "")[:250]
    block = list(itertools.takewhile(lambda r: r[1][:8] == others[0][1][:8], others))
    tags = list(dict.fromkeys(t for r in block for t in r[4] or [] if t is not None and t.lower() not in SUMMARY_SKIPPED_TAGS))
    if tags:
        return ("Last session topics: " + ", ".join(tags[:8]))[:250]
    return ("Last session: " + " | ".join((r[3] or "")[:40] for r in block[:3]))[:250] if block else ""


@pytest.mark.parametrize("seed", range(6))
def test_last_session_without_a_checkpoint(spark, seed):
    rnd = random.Random(seed)
    names = ["aaaaaaaa-1", "aaaaaaaa-2", "bbbbbbbb", "cccccccc", "unknown", None, ""][: 2 + seed]
    tags = ["Repeated", "stop_hook", None, *"abcdefghij"] if seed % 2 else ["repeated"]
    log = [(i, rnd.choice(names), rnd.choice(["x", None]), rnd.choice([None, f"content {i} " + "z" * 40]), rnd.choice([None, rnd.choices(tags, k=3)])) for i in range(rnd.choice([3, 12, 40]))]
    asking = [*names, "dddddddd", None]
    df = spark.createDataFrame(log, "line_num long, session_id string, type string, content string, tags array<string>")
    got = {r["session_id"]: r["summary"] for r in capture.last_session(df, spark.createDataFrame([(a,) for a in asking], "session_id string")).collect()}
    assert got == {a: walked_back(log, a) for a in asking}


def test_session_summary_serves_every_session(spark, tmp_path):
    spark.createDataFrame([(1, "aaaaaaaa", "SESSION_CHECKPOINT", "first", ["x"])], "line_num long, session_id string, type string, content string, tags array<string>").write.parquet(f"{tmp_path}/memory_log.parquet")
    spark.createDataFrame([(7, "a", "bbbbbbbb"), (8, "b", "cccccccc"), (9, "b", "cccccccc"), (11, "c", None), (100, "d", "aaaaaaaa")], "doc_id long, text string, session_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["session_id"], r["summary"]) for r in catalog.session_summary(spark, str(tmp_path)).collect()]
    assert len(got) == 4 and dict(got) == {"aaaaaaaa": "", "bbbbbbbb": "first", "cccccccc": "first", None: "first"}


def test_resolutions_by_anyone(spark):
    rnd = random.Random(5)
    acts = [(i, rnd.choice("abc"), rnd.randrange(0, 4 * 3600, 20), rnd.choice(["TRIED-FAILED", "INFRA", "CHANGED"]), rnd.choice(["short", "a description of it"]), "make", "Error: exit of a step") for i in range(200)]
    acts += [(300, "a", 7199, "TRIED-FAILED", "x", "make", "Error: exit of a step"), (301, "b", 7201, "INFRA", "a description of it", "make", None)]
    df = spark.createDataFrame(acts, "event_id long, session_id string, at long, category string, description string, command string, error string").withColumn("ts", F.timestamp_seconds("at"))
    want = {}
    for e in acts:
        later = [f for f in acts if f[3] != "TRIED-FAILED" and len(f[4]) >= 15 and (f[2], f[0]) > (e[2], e[0]) and f[2] - e[2] <= 300]
        if e[3] == "TRIED-FAILED" and later:
            want[e[0]] = min(later, key=lambda f: (f[2], f[0]))[0]
    got = [(r["event_id"], r["fixed_by"]) for r in events.resolutions_by_anyone(df, 300).collect()]
    assert len(got) == len(want) and dict(got) == want and 300 in want
