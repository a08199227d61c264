"""The whole score against a plain reimplementation on a few entries."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DEFAULT
from tidemark.functions.fixed import PRIORITY_TYPES, SUFFIXES
from tidemark.operators import inject, score, search, topk
from tidemark.plans import catalog

LOG = "line_num long, type string, content string, tags array<string>, logged_at string, session_id string, source string, extra string"
CORE = "core_id long, section string, content string, tags array<string>, priority int, type string"
ALIAS = "alias_key string, expansions array<string>"
ROWS = [
    (1, "USER_CORRECTION", "Always deploy the gateway service after every parser change", ["parser", None], "2026-10-30T00:00:00Z", "a", "x", ""),
    (2, "working_solution", "Deploying gateways needs the queue drained first today", ["ops"], "2026-10-01T00:00:00+02:00", "a", "x", ""),
    (3, None, "The parsers of the old compiler broke on long tokens", None, "bad", "b", None, ""),
    (4, "x", "short", ["parser"], None, None, None, ""),
    (5, "x", None, None, None, None, None, ""),
    (6, "CONFIG_INSIGHT", "Queue length limits were raised for nightly gateway runs", [], "2028-01-01T00:00:00Z", "c", "x", ""),
    (7, "CONFIG_INSIGHT", "Queue length limits were raised for nightly gateway runs", [], "2028-01-01T00:00:00Z", "c", "x", ""),
]
CORES = [(101, "Ops", "Gateway parser settings live next to the deployment notes", ["gateway"], 5, "CONFIG_INSIGHT"), (102, None, None, None, None, None)]
ALIASES = [("que", ["queue", None]), ("gw", ["gateway"]), (None, ["x"])]
QUERIES = [(1, "gateway parser deployment"), (2, "que length"), (3, "compil"), (4, "a b"), (5, "gateway queue parser tokens limits nightly runs deploy compiler change service drained")]


def stem(w):
    if len(w) <= 4:
        return w
    for s in SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= 3:
            return w[: -len(s)]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def words(s):
    return set(re.findall(r"\w{3,}", s.lower()))


def expected():
    def entry(i, kind, content, tags, section, priority, age):
        content, kind, section = content or "", kind or "", section or ""
        tag = " ".join(t or "" for t in tags or [])
        return {"id": i, "kind": kind, "content": content, "tags": words(tag), "tokens": words(f"{content} {tag} {kind} {section}"), "priority": priority or 0, "age": age}

    ages = {1: 2.0, 2: 31 + 2 / 24}
    log = [entry(r[0], r[1], r[2], r[3], "", 0, ages.get(r[0], 0.0)) for r in ROWS]
    core = [entry(r[0], r[5], r[2], r[3], r[1], r[4], 0.0) for r in CORES]
    every = log + core
    df = {}
    for e in every:
        for t in e["tokens"]:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + len(every) / n) for t, n in df.items()}
    out = {}
    for qid, text in QUERIES:
        q = sorted(words(text), key=lambda t: (-idf.get(t, max(idf.values())), t))[:10]
        total = sum(idf.get(t, 1.0) for t in q)
        scores = []
        for e in log:
            if e["id"] in (4, 5):
                continue
            direct = {t for t in q if t in e["tokens"]}
            exact = direct | {k for k, xs in ALIASES if k in q and any(x in e["tokens"] for x in xs if x)}
            stems = {stem(t) for t in q} & {stem(t) for t in e["tokens"]}

            def part(qs, es):
                return sum(0.5 * idf.get(a, 1.0) for a in qs if any(a != b and (a in b or b in a) and min(len(a), len(b)) / max(len(a), len(b)) >= 0.5 for b in es))

            if exact:
                only = stems - {stem(t) for t in exact}
                m = (sum(idf.get(t, 1.0) for t in exact) + 0.7 * sum(idf.get(s, 1.0) for s in only) + 0.5 * part(set(q) - exact, e["tokens"] - exact)) / total
            elif stems:
                m = 0.7 * sum(idf.get(s, 1.0) for s in stems) / total
            else:
                m = part(q, e["tokens"]) / total if q else 0
            if not m:
                continue
            strong = (m >= 0.3 or (m >= 0.15 and exact)) and len(q) >= 3
            boost = (2.0 if set(q) & e["tags"] else 1.0) * (1.5 if e["kind"].lower() in PRIORITY_TYPES else 1.0) if strong else 1.0
            cover = max(0.15, min(1.0, 3 * len(direct) / math.sqrt(len(e["tokens"])))) if exact and len(e["tokens"]) > 3 else 1.0
            s = round(m * boost * (1 + 0.1 * e["priority"]) * math.exp(-0.03 * e["age"]) * cover, 6)
            if s > 0:
                scores.append((-s, e["id"]))
        out[qid] = [(i, -s) for s, i in sorted(scores)[:5]]
    return out


@pytest.fixture(scope="module")
def indexes(spark):
    return search.build(spark.createDataFrame(ROWS, LOG), spark.createDataFrame(CORES, CORE), spark.createDataFrame(ALIASES, ALIAS))


def test_scores_match_a_plain_implementation(spark, indexes):
    got: dict = {}
    for r in search.search(spark.createDataFrame(QUERIES, "query_id long, text string"), indexes[0]).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["entry_id"], pytest.approx(r["score"], abs=2e-6)))
    want = {k: v for k, v in expected().items() if v}
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert got == want
    assert want[3] and want[2]  # substring and alias matches are part of it


def test_empty_tables(spark):
    log, core = search.build(spark.createDataFrame([], LOG), spark.createDataFrame([], CORE), spark.createDataFrame([], ALIAS))
    assert search.search(spark.createDataFrame(QUERIES, "query_id long, text string"), log).count() == 0


def test_cluster_merge(spark):
    hot = spark.createDataFrame(
        [(1, 1, 11, "X", "alpha beta gamma delta"), (1, 2, 12, "USER_CORRECTION", "alpha beta gamma delta"), (1, 3, 13, "X", "alpha beta gamma omega"), (1, 4, 14, None, "other words entirely"), (2, 1, 15, "X", "single")],
        "query_id long, rank int, entry_id long, kind string, content string",
    )
    got = [(r["query_id"], r["place"], r["entry_id"], r["content"]) for r in inject.clustered(hot).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, 12, "alpha beta gamma delta"), (1, 2, 11, "alpha beta gamma delta (+1 related)"), (1, 3, 14, "other words entirely"), (2, 1, 15, "single")]


def test_budget_stops_at_the_first_overflow(spark):
    schema = "query_id long, place int, kind string, content string"
    hot = spark.createDataFrame([(1, 1, "A", "x" * 1000), (1, 2, "A", "y" * 3000), (1, 3, "A", "z")], schema)
    warm = spark.createDataFrame([(1, 1, "B", "w" * 200), (2, 1, "B", "v")], schema)
    got = [(r["query_id"], r["tier"], r["place"]) for r in inject.budgeted(hot, warm).orderBy("query_id", "tier", "place").collect()]
    assert got == [(1, "HOT", 1), (1, "WARM", 1), (2, "WARM", 1)]


def test_tiers(spark):
    rows = spark.createDataFrame([(1, 0.3, 2), (2, 0.3, 1), (3, 0.29, 2), (4, 0.14, 5)], "entry_id long, score double, exact_matches int")
    assert {(r["entry_id"], r["tier"]) for r in inject.tiered(rows).collect()} == {(1, "HOT"), (3, "WARM")}


def test_gate(spark):
    m = spark.createDataFrame([("s", "2026-01-01 00:00:00", 1), ("t", "2026-01-01 00:00:00", 1), ("u", "2026-01-01 00:00:00", 0), (None, None, 1)], "session_id string, at string, count long").select("session_id", F.to_timestamp("at").alias("created_at"), "count")
    c = spark.createDataFrame([("s", "2026-01-01 00:10:00", 1), ("s", "2026-01-01 00:10:01", 2), ("t", "2026-01-01 00:10:01", 3), ("u", "2026-01-01 00:00:01", 4)], "session_id string, at string, event_id long").select("session_id", F.to_timestamp("at").alias("ts"), "event_id")
    assert [r["event_id"] for r in inject.gate(m, c, DEFAULT).collect()] == [1]


def test_admission(spark):
    p = [(1, "short prompt", "s"), (2, "/run the whole test suite", "s"), (3, "<task-notification> something done here", "s"), (4, "Why does the gateway drop requests", "s"), (5, None, "s")]
    assert [r["query_id"] for r in inject.admitted(spark.createDataFrame(p, "query_id long, prompt string, session_id string")).collect()] == [4]


@pytest.mark.parametrize("k, least, mode", [(5, 0.0, {}), (1, 0.05, {}), (3, 0.0, {"cached": True}), (5, 0.0, {"only_exact": True})])
def test_passing_over_loses_nothing(spark, monkeypatch, k, least, mode):
    """Results from packed parts are those of the scores of all pairs."""
    monkeypatch.setattr(topk, "PART", 1500)
    draw = random.Random(7)
    names = [a + b for a in ("parse", "queue", "deploy", "lock", "cache") for b in ("", "r", "s", "ing", "ment", "line")] + ["the", "and", "for", "when"] * 5

    def text(n):
        return "The " + " ".join(draw.choice(names) for _ in range(n)) + f" id{draw.randrange(900)}"

    rows = [(i, draw.choice(["USER_CORRECTION", "note", None]), text(draw.randrange(5, 15)), draw.sample(names, 2), f"2026-{draw.randrange(1, 11):02d}-{draw.randrange(1, 29):02d}T00:00:00Z", "a", "x", "") for i in range(4000)]
    log, _ = search.build(spark.createDataFrame(rows, LOG), spark.createDataFrame(CORES, CORE), spark.createDataFrame(ALIASES, ALIAS))
    asked = spark.createDataFrame([(i, text(draw.randrange(1, 12))) for i in range(60)] + [(None, "queue")], "query_id long, text string")
    tokens = search.tokens_of(asked.where("query_id is not null"), log)
    found = score.evidence(tokens, log.postings, log.aliases, log.weights, log.vocabulary, **{m: v for m, v in mode.items() if m == "only_exact"})
    if "cached" in mode:
        found = found.join(found.where("part <> 'p'").select("query_id", "entry_id").distinct(), ["query_id", "entry_id"], "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    every = score.scored(tokens, found, log.entries).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") >= least))
    pick = ["query_id", "entry_id", "rank", "match", "n_exact", "score"]
    want = sorted(every.select(pick).collect())
    assert len(want) >= 40
    assert sorted(search.search(asked, log, k, least=least, **mode).select(pick).collect()) == [(*w[:3], pytest.approx(w[3], abs=2e-6), w[4], pytest.approx(w[5], abs=2e-6)) for w in want]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The tables of the read path; no document has an id divisible by 100."""
    folder = str(tmp_path_factory.mktemp("tables"))
    said = "We decided using plain billing ledgers needed fewer migrations than storing everything within one giant spreadsheet was costing."
    docs = [(i, f"Why does the gateway parser deploy break number {i} of the queue service? {said}", "s") for i in (7, 42, 151)]
    spark.createDataFrame(ROWS, LOG).write.parquet(f"{folder}/memory_log.parquet")
    spark.createDataFrame(CORES, CORE).write.parquet(f"{folder}/core_tagged.parquet")
    spark.createDataFrame(ALIASES, ALIAS).write.parquet(f"{folder}/aliases.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, session_id string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_ack_markers_ask_for_every_document(spark, tables):
    assert {r["query_id"] for r in catalog.ack_markers(spark, tables).collect()} == {7, 42, 151}


def test_assembled_context_serves_every_document(spark, tables):
    assert {r["query_id"] for r in catalog.assembled_context(spark, tables).collect()} == {7, 42, 151}


def test_new_decisions_of_every_document(spark, tables):
    assert {r["doc_id"] for r in catalog.decisions_new(spark, tables).collect()} == {7, 42, 151}
