"""Pair operators against brute force on small dirty tables."""

import random
import re

import pytest

from tidemark.llm import formatdup, history, neardup, setjoin
from tidemark.llm.common import expand
from tidemark.operators.signatures import word_counts

LOG = "line_num long, content string, tags array<string>, session_id string, id string, hashes string"
CORE = "core_id long, content string, tags array<string>, n string"


def words(s):
    return frozenset(re.findall(r"\w+", s.lower()))


def letters(s):
    return re.sub(r"[\W_]+", "", s.lower())


def tagset(tags):
    return frozenset(letters(t) for t in tags or [] if t and letters(t))


def log_rows(n=160, seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "naïve", "ß", "x_1"]
    rows, texts = [], []
    for i in range(1, n + 1):
        kind = rnd.random()
        if kind < 0.45 and texts:  # an edited, reformatted or plain copy
            ws = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                ws[rnd.randrange(len(ws))] = rnd.choice(vocabulary)
            text = rnd.choice([" ", "  ", ", "]).join(ws)
            text = rnd.choice([text, text.upper(), text + "."])
        else:
            text = " ".join(rnd.sample(vocabulary, rnd.choice([3, 8, 12, 14, 20, 30])))
        texts.append(text)
        tags = [rnd.choice(["Git", "git ", "py-3", "PY3", "ops", "a", "b", "c", "d", "e", "f", None, " ", "g", "h"]) for _ in range(rnd.randint(0, 12))]
        rows.append((i, text, tags if rnd.random() > 0.1 else None, rnd.choice([None, "", "unknown", "s1", "s2", f"s{i // 5}"]), "clash", "clash"))
    third = "the same long text that a third of all the rows of this table say again and again"
    rows += [(n + i, third.upper() + "!" if i % 2 else third, ["A ", "b", "c", "d", "e", "f"][:: 1 if i % 3 else -1], f"t{i}", None, None) for i in range(1, n // 2)]
    rows += [(900, None, None, None, None, None), (901, "", [], "", None, None), (902, "…", [None], None, None, None), (None, third, None, None, None, None), (903, " ".join(f"v{i}" for i in range(3000)), [f"t{i}" for i in range(60)], "s1", None, None)]
    rows += [(904, rows[-1][1] + " more", [f"t{i}" for i in range(58)] + ["x", "y"], "s2", None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return log_rows()


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, LOG).repartition(3)


def pairs_of(df):
    got = [(r[0], r[1]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute(sets, least, num, den):
    items = [(i, s) for i, s in sets if i is not None and len(s) >= least]
    return {(min(i, j), max(i, j)) for i, a in items for j, b in items if i < j and den * len(a & b) >= num * len(a | b)}


def test_near_duplicates(spark, log, rows):
    texts = log.selectExpr("line_num as id", "content", "tags as rep")
    want = brute([(r[0], words(r[1] or "")) for r in rows], 12, 8, 10)
    assert len(want) > 1000 and pairs_of(neardup.found(texts)) == want
    groups = neardup.groups(texts).collect()
    assert len(groups) == len({r["id"] for r in groups}) == sum(1 for r in rows if r[0] is not None and len(words(r[1] or "")) >= 12)
    assert max(r["class_size"] for r in groups) >= 79


@pytest.mark.parametrize("num,den", [(1, 2), (9, 10), (1, 1)])
def test_near_duplicates_at_other_thresholds(spark, log, rows, num, den):
    want = brute([(r[0], words(r[1] or "")) for r in rows], 3, num, den)
    assert pairs_of(expand(*neardup.near_classes(log.selectExpr("line_num as id", "content"), 3, num, den))) == want


def test_set_join(spark, log, rows):
    core = spark.createDataFrame([(2001, "x", ["A", "b", "C", "d", "E", "f", "g"], "clash"), (2002, None, None, None)], CORE)
    sets = [(r[0], tagset(r[2])) for r in rows] + [(2001, tagset(["a", "b", "c", "d", "e", "f", "g"]))]
    want = brute(sets, 6, 6, 10)
    assert want and pairs_of(setjoin.found(log, core)) == want
    linked = setjoin.linked(log, core).collect()
    assert len(linked) == sum(1 for i, s in sets if i is not None and len(s) >= 6)


def test_set_join_of_frequent_tags(spark):
    # no tag tells much, and many segments are empty
    rnd = random.Random(8)
    sets = {tuple(sorted(f"t{x}" for x in rnd.sample(range(16), rnd.randint(6, 12)))) for _ in range(700)}
    sets = [(i, list(s)) for i, s in enumerate(sorted(sets))]
    df = spark.createDataFrame(sets, "id long, items array<string>")
    for num, den in ((6, 10), (8, 10), (3, 10)):
        assert pairs_of(expand(*setjoin.similar_sets(df, 6, num, den))) == brute([(i, frozenset(s)) for i, s in sets], 6, num, den)


def test_candidates_of_the_set_join_do_not_grow_with_the_square(spark):
    def count(n):
        rnd = random.Random(9)
        tags = [f"t{i}" for i in range(120)]
        sets = {tuple(sorted(rnd.choices(tags, [1 / (i + 1) for i in range(120)], k=12)[:7] + [f"own{i // 2}"])) for i in range(n)}
        df = spark.createDataFrame([(i, sorted(set(s))) for i, s in enumerate(sets)], "id long, items array<string>")
        return setjoin.candidates(setjoin.distinct_sets(df, 6), 6, 6, 10).count()

    small, large = count(300), count(3000)
    assert large < 25 * max(small, 20)


def test_set_join_of_long_sets(spark):
    rnd = random.Random(1)
    sets = []
    for i in range(60):
        base = sets[-1] if i % 3 else []
        keep = [x for x in base if rnd.random() > 0.12]
        sets.append(sorted({*keep, *(f"t{rnd.randrange(400)}" for _ in range(60 - len(keep)))}))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, items array<string>")
    assert pairs_of(expand(*setjoin.similar_sets(df))) == brute([(i, frozenset(s)) for i, s in enumerate(sets)], 6, 6, 10)


def test_format_duplicates(spark, log, rows):
    groups = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and len(letters(r[1])) >= 20:
            groups.setdefault((letters(r[1]), tagset(r[2])), []).append(r[0])
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert len(want) >= 78 and pairs_of(formatdup.found(log)) == want
    counts = {r["line_num"]: r["n_copies"] for r in formatdup.collapsed(log).collect()}
    assert sum(counts.values()) == len({r[0] for r in rows if r[0] is not None}) and counts[161] >= 79


def test_histograms_do_not_depend_on_format():
    import pyarrow as pa

    texts = ["Ab c-1", "a B\tC1", "AB C 1é", "ab c1 É", None, "", "K"]
    h = formatdup.histograms(pa.array(texts))
    assert (h[0] == h[1]).all() and (h[2] == h[3]).all() and not h[4].any() and not h[5].any() and h[6].sum() == 1
    assert (formatdup.histograms(pa.array(texts).slice(2, 3))[0] == h[2]).all()


def sequential(rows):
    start = {}
    for i, _, _, s, *_ in rows:
        if i is not None and s not in (None, "", "unknown"):
            start[s] = min(start.get(s, i), i)
    by_batch = {}
    for i, c, _, s, *_ in rows:
        if i is not None:
            by_batch.setdefault(start.get(s, i) if s not in (None, "", "unknown") else i, []).append((i, words(c or ""), letters(c or "")))
    accepted, cases = [], set()
    for b in sorted(by_batch):
        new = []
        for i, w, k in by_batch[b]:
            case = any((len(k) >= 20 and k == k2) or (len(w) >= 12 and len(w2) >= 12 and 10 * len(w & w2) >= 8 * len(w | w2)) for w2, k2 in accepted)
            cases.add(i) if case else new.append((w, k))
        accepted += new
    return cases


@pytest.mark.parametrize("portions,bucket_rows,fan", [(1, 1 << 20, 8), (3, 64, 8), (7, 32, 2)])
def test_history(spark, log, rows, portions, bucket_rows, fan):
    got = [r[0] for r in history.found(log, portions, bucket_rows, fan).collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(rows)


def test_late_rows_belong_to_their_batch(spark):
    base = [f"word{i}" for i in range(20)]
    texts = [(i, " ".join([*base[1:], f"x{i}"]) if i % 3 else f"filler {i} {i}", None, "late" if i in (2, *range(700, 1400)) else None) for i in range(1, 1400)]
    log = spark.createDataFrame(texts, "line_num long, content string, tags array<string>, session_id string")
    assert {r[0] for r in history.found(log, 3).collect()} == sequential(texts)


def test_chains_are_settled_link_by_link(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 20]), None, None) for i in range(1, 40)]  # each is near the one or two before
    log = spark.createDataFrame(rows, "line_num long, content string, tags array<string>, session_id string")
    want = sequential(rows)
    assert 15 < len(want) < 30 and {r[0] for r in history.found(log, 1).collect()} == want


@pytest.mark.parametrize("portions", [1, 2, 3])
def test_history_does_not_link_to_rows_rejected_by_their_key(spark, portions):
    joined = " ".join(f"field{i}_limit{i}" for i in range(14))
    split = joined.replace("_", " ")
    texts = [joined, split, *("short" for _ in range(8)), split + " extra", split + " extra more"]
    rows = [(i, t, None, None) for i, t in enumerate(texts, 1)]
    log = spark.createDataFrame(rows, "line_num long, content string, tags array<string>, session_id string")
    assert sequential(rows) == {2, 12}
    assert {r[0] for r in history.found(log, portions).collect()} == {2, 12}


def test_history_is_kept_in_its_folder(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(20))
    texts = spark.createDataFrame([(1, base), (2, base + " more"), (3, "short"), (4, base.upper()), (5, base.replace("word0", "x"))], "id long, content string")

    def ingest(ids):
        h = history.History(spark, f"file://{tmp_path}/index", bucket_rows=4, fan=2)
        part = texts.where(f"id in ({ids})")
        signed = h.sign(part)
        return [r[0] for r in h.ingest(signed.withColumn("batch", signed["id"]), part).collect()]

    assert ingest("1") == [] and sorted(ingest("2, 3")) == [2] and ingest("4") == [4] and ingest("5") == [5]
    # what an ingest left behind before it was committed does not count
    (tmp_path / "index" / "state.json").unlink()
    assert ingest("1") == [] and ingest("5") == [5]


def test_the_word_order_is_not_sent_out_again_by_the_driver(spark, tmp_path, monkeypatch):
    # as a table of the driver's, a large order did not fit into its heap or into one task
    texts = spark.createDataFrame([(i, " ".join(f"w{i % 7}_{k}" for k in range(14))) for i in range(30)], "id long, content string")

    def refused(*_, **__):
        raise AssertionError("the driver makes a table")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    counts = history.History(spark, f"file://{tmp_path}/index").ranks(texts).value
    assert (counts == word_counts(texts, history.MIN_WORDS)).all() and counts.sum() == 30 * 14
    assert (history.History(spark, f"file://{tmp_path}/index").ranks(None).value == counts).all()


def test_an_ingest_reads_the_buckets_of_its_batch(spark):
    h = history.History(spark, bucket_rows=64)
    texts = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(14))) for i in range(400)] + [(500, " ".join(f"w7_{k}" for k in range(14)))], "id long, content string")
    for part in (texts.where("id < 400"), texts.where("id = 500")):
        signed = h.sign(part)
        cases = h.ingest(signed.withColumn("batch", signed["id"]), part)
    assert [r[0] for r in cases.collect()] == [500]
    segments = h.shelves["postings"].segments
    assert segments[0][1] >= 16
    near = h.shelves["postings"].near(spark.createDataFrame([(5,), (5 + segments[0][1],)], "slot int"))
    assert 0 < near.count() < segments[0][2] / 4


def test_buckets_have_the_rows_they_are_meant_to_have(spark):
    # their number followed from the words of the rows, which are several times the postings
    h = history.History(spark, bucket_rows=64)
    texts = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(14))) for i in range(400)], "id long, content string")
    signed = h.sign(texts)
    assert h.ingest(signed.withColumn("batch", signed["id"]), texts).count() == 0
    for shelf, rows in (("postings", 1200), ("keys", 400), ("texts", 400)):
        ((_, buckets, n),) = h.shelves[shelf].segments
        assert n == rows and buckets * 64 / 2 < n <= buckets * 64


def test_wide_rows_are_not_sorted_to_be_joined(spark, log, rows, monkeypatch):
    # signatures and texts were sorted for their joins with ids, and the batches were made twice
    plans = {}
    stage, append = history.staged, history.Shelf.append

    def plan(df):
        return df._jdf.queryExecution().toString()

    def staged(df, name, *by):
        plans.setdefault(name, plan(df))
        return stage(df, name, *by)

    def appended(self, rows, number, most):
        plans[self.folder.rpartition("/")[2]] = plan(rows)
        append(self, rows, number, most)

    monkeypatch.setattr(history, "staged", staged)
    monkeypatch.setattr(history.Shelf, "append", appended)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r[0] for r in history.found(log).collect()} == sequential(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("signed", "texts"):
        assert "ShuffledHashJoin [id" in plans[name]
    assert "SortMergeJoin" not in plans["signed"] and "session#" not in plans["signed"]


def test_empty_tables(spark):
    log, core = spark.createDataFrame([], LOG), spark.createDataFrame([], CORE)
    assert neardup.found(log.selectExpr("line_num as id", "content")).count() == 0
    assert setjoin.found(log, core).count() == formatdup.found(log).count() == history.found(log).count() == 0
