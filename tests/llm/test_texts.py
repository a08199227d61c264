import math
import random
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import cutoff, mixing, packing, pii, tokens, twopoisson

DATA = "/root/testdata/sf0.001"
needs_vocabulary = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no tokenizer files here")


def test_two_poisson_fit_finds_the_elite():
    # 4 of 10000 records are about the term (5 times each), 6 mention it
    share, low, high = (x[0] for x in twopoisson.fit(np.array([1, 5]), np.array([6, 4]), np.array([0]), 10_000))
    assert share == pytest.approx(4e-4, rel=0.2) and high == pytest.approx(5, rel=0.1) and low < 0.002

    def elite(k):
        return 1 / (1 + math.exp(math.log((1 - share) / share) + high - low - k * math.log(high / low)))

    assert elite(5) > 0.99 and elite(1) < 0.1


def test_two_poisson_fits_do_not_depend_on_each_other():
    a, b = ([1, 2, 7], [50, 5, 2]), ([1], [3])
    both = twopoisson.fit(np.array(a[0] + b[0]), np.array(a[1] + b[1]), np.array([0, 3]), 1000)
    alone = twopoisson.fit(np.array(a[0]), np.array(a[1]), np.array([0]), 1000)
    assert all(x[0] == pytest.approx(y[0]) for x, y in zip(both, alone))


LOG = "line_num long, type string, content string, source string, term string, k string"


def test_marking_terms(spark):
    filler = [(i, "x", f"the cache of node{i} was read and the queue was written again", None, None, None) for i in range(1, 60)]
    rows = [*filler, (100, " Session_Checkpoint ", "Session: the cache of zorvex, the queue zorvex, zorvex again, cache lonely lonely lonely", None, None, None), (101, "x", "about zorvex", None, None, None), (102, "SESSION_CHECKPOINT", None, None, None, None), (103, "SESSION_CHECKPOINT", "", None, None, None)]
    log = spark.createDataFrame(rows, LOG)
    assert [(r[0], r[1]) for r in twopoisson.found(log).collect()] == [(100, "zorvex")]
    scores = {(r["line_num"], r["term"]): r["score"] for r in twopoisson.beside_stale(log, spark.createDataFrame([("cache", 1.5), ("cache", 2.0), (None, 1.0)], "token string, weight double"), spark.createDataFrame([(100, "cache zorvex"), (1, None)], "line_num long, tokens string")).collect()}
    assert scores[(100, "zorvex")] > 10 * scores[(100, "the")]
    assert twopoisson.found(spark.createDataFrame([], LOG)).count() == 0


def test_cut_texts_of_known_kinds(spark):
    rnd = random.Random(2)
    nouns = [f"noun{c * n}" for c in "abcdefgh" for n in range(2, 30, 3)]
    rows = []
    for i in range(1, 1500):
        rows.append([i, f"The {rnd.choice(nouns)} was moved into the {rnd.choice(nouns)} because the {rnd.choice(nouns)} failed during the night.", "s"])
    whole = {}
    for i in range(0, 100, 4):
        rows[i][1] = rows[i][1].rstrip(".")  # unpunctuated
        rows[i + 1][1] = rows[i + 1][1][: rows[i + 1][1].index("into") + 8]  # after "into the"
        rows[i + 2][1] = rows[i + 2][1][: rows[i + 2][1].index(" failed") - 1]  # in a word
        rows[i + 3][1] += " and so on..."
        whole |= {i + 1: False, i + 2: True, i + 3: True, i + 4: False}
    rows += [[2000, None, "s"], [2001, " ", "s"], [2002, "done", None], [2003, "done", None], [2004, "done", None], [2005, "done", None], [None, "done", None], [2006, "Timeout in the �", "s"]]
    log = spark.createDataFrame([tuple(r) for r in rows], "line_num long, content string, source string").repartition(3)
    got = {r[0] for r in cutoff.found(log).collect()}
    assert {i for i, cut in whole.items() if cut} <= got and not {i for i, cut in whole.items() if not cut} & got
    assert 2006 in got and not got & {2000, 2001, 2002, 2003}
    shares = {r["source"]: r for r in cutoff.shares(log).collect()}
    assert shares["s"]["n_cut"] == len(got) and shares[None]["n_cut"] == 0
    assert cutoff.found(log.limit(0)).count() == 0


def test_copies_of_a_cut_text_do_not_vouch_for_each_other(spark):
    rnd = random.Random(3)
    nouns = [f"noun{c * n}" for c in "abcdefgh" for n in range(2, 30, 3)]
    rows = [(i, f"The {rnd.choice(nouns)} was moved into the {rnd.choice(nouns)} because the {rnd.choice(nouns)} failed during the night.", "s") for i in range(1, 800)]
    cut = ["The crate was hauled over into the", "The crate fell down the stairs because the nou"]
    rows += [(1000 + 100 * k + i, t, f"source{i}") for k, t in enumerate([*cut, "same as before"]) for i in range(20)]
    got = {r[0] for r in cutoff.found(spark.createDataFrame(rows, "line_num long, content string, source string").repartition(3)).collect()}
    assert got == {1000 + 100 * k + i for k in range(2) for i in range(20)}


def test_final_words_of_any_length():
    assert cutoff._last_word("see " + "Ab" * 150 + " ``!!") == "ab" * 150 and cutoff._last_word("... !") == "" and cutoff._last_word("") == ""


def test_bitmap_of_wanted_codes_is_sized_by_their_number(spark):
    codes = spark.range(0, 20_000).selectExpr("xxhash64(id % 10000) as code")
    wanted = cutoff._wanted(codes)
    have = np.array([r[0] for r in codes.distinct().collect()], np.int64)
    others = np.array([r[0] for r in spark.range(50_000, 60_000).selectExpr("xxhash64(id)").collect()], np.int64)
    assert wanted.bits in (18, 19) and wanted.has(have).all() and wanted.has(others).mean() < 0.08


@pytest.mark.parametrize("size", [5, 30, 31, 80])
def test_ends_have_the_codes_that_are_counted(size):
    text = "It began. " + " ".join(f"w{i % 7}" for i in range(size))
    common = SimpleNamespace(value={f"w{i}": 4 + i for i in range(7)})
    batch = pa.RecordBatch.from_pydict({"line_num": [1], "source": ["s"], "content": [text], "digest": [1]})
    (tail,) = next(cutoff._tails(common)(iter([batch])))["codes"].to_pylist()
    counted = cutoff._codes(*cutoff._symbols([text], cutoff._Mapper(common.value)))
    assert tail == [c[-1] for c in counted]


@pytest.mark.parametrize("seed", range(4))
def test_packing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([16, 100, 512])
    sizes = [rnd.choice([rnd.randint(1, capacity // 4), rnd.randint(1, capacity), rnd.randint(1, 4 * capacity)]) for _ in range(600)]
    placed, n = packing.pack(sizes, capacity)
    used, parts = {}, {}
    for at, i, piece, first, size in placed:
        used[at] = used.get(at, 0) + size
        parts.setdefault(i, []).append((piece, first, size))
    assert max(used.values()) <= capacity and set(used) == set(range(n))
    for i, size in enumerate(sizes):
        ps = sorted(parts[i])
        assert sum(p[2] for p in ps) == size and [p[1] for p in ps] == [sum(q[2] for q in ps[:k]) for k in range(len(ps))]
        assert len(ps) == 1 or size > capacity and all(p[2] == capacity for p in ps[:-1])
    assert n <= 1.25 * -(-sum(sizes) // capacity) + 1


def test_packing_of_nothing_and_ties():
    assert packing.pack([], 10) == ([], 0)
    assert packing.pack([5, 5, 5, 5], 10)[1] == 2 and packing.pack([10, 20], 10)[1] == 3


DOCS = "doc_id long, text string, source string, lang string, kind string, n_tokens string, shard string"


@needs_vocabulary
def test_containers(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", None, None, None, "x", "y"), (2, None, None, None, None, None, None), (3, "", None, None, None, None, None), (4, "word " * 5000, None, None, None, None, None), (None, "x", None, None, None, None, None)], DOCS)
    sizes = spark.createDataFrame([("s", 16), ("s", 8), ("m", 4096), ("bad", None), (None, 5), ("zero", 0)], "container_kind string, capacity_tokens int")
    rows = packing.containers(docs, sizes).collect()
    text = {1: "a b c d e f g", 4: "word " * 5000}
    for kind in ("s", "m"):
        for doc, t in text.items():
            assert sum(r["n_tokens"] for r in rows if r["container_kind"] == kind and r["doc_id"] == doc) == len(tokens.encoder().encode_ordinary(t))
    assert {r["container_kind"] for r in rows} == {"s", "m"}
    assert packing.containers(docs.limit(0), sizes).count() == 0
    assert all(0.9 < r["fill"] <= 1 for r in packing.fill(docs, sizes).collect() if r["container_kind"] == "s")


def test_raking():
    mass = np.array([10.0, 30.0, 20.0, 40.0])
    groups = [np.array([0, 1, 0, 1]), np.array([0, 0, 1, 1])]
    targets = [np.array([0.5, 0.5]), np.array([0.7, 0.3])]
    w = mixing.rake(mass, groups, targets) * mass
    for g, t in zip(groups, targets):
        assert np.bincount(g, w) / w.sum() == pytest.approx(t, abs=1e-6)


def test_flattened_shares_move_the_raked_weights():
    mass = np.array([900.0, 80.0, 20.0, 300.0, 300.0])
    source, lang = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 0, 1])
    share = np.array([0.4, 0.6])
    target = mixing.flattened(mass, source, lang, share, 0.7)
    alone = mass * (share / np.bincount(source, mass))[source]
    weighed = mixing.rake(mass, [lang, source], [target, share]) * mass
    assert np.bincount(source, weighed) / weighed.sum() == pytest.approx(share)
    assert np.bincount(lang, weighed) / weighed.sum() == pytest.approx(target, abs=1e-6)
    assert abs(target - np.bincount(lang, alone)).max() > 0.01 and target.sum() == pytest.approx(1)


@needs_vocabulary
def test_sources_with_suffixes_are_told_apart(spark):
    docs = spark.createDataFrame([(i, "some words here", s, "en", "a", "x", "y") for i, s in enumerate(["x-a", "X-A ", "x-b", "x-b-old", "y", "other"] * 20)], DOCS)
    targets = spark.createDataFrame([("x-a", 0.25, 1), ("X-a", 0.25, 1), ("x-b", 0.5, 2)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert set(shares) == {"x-a", "x-b"} and all(r["actual_share"] == pytest.approx(0.5, abs=0.02) and r["target_share"] == pytest.approx(0.5) for r in shares.values())
    reached = {(r["axis"], r["value"]): r for r in mixing.marginals(docs, targets).collect()}
    assert reached["lang", "en"]["actual_share"] == 1 and reached["source", "x-a"]["expected_share"] == pytest.approx(0.5)


@needs_vocabulary
def test_mixture(spark):
    rnd = random.Random(4)
    names = {"big": ["big", "BIG ", "Big"], "small": ["small"], "tiny": ["tiny"], "none": ["none"]}
    rows = [(i, "tok " * rnd.randint(1, 200), rnd.choice(names[rnd.choices(["big", "small", "tiny", "none"], [60, 30, 6, 4])[0]]), rnd.choice(["en", "EN", "en-XX", "de", None]), rnd.choice(["a", "b", None]), "x", "y") for i in range(800)]
    rows += [(2000, None, "big", None, None, None, None), (2001, "", "big", None, None, None, None), (2002, "x", None, "en", "a", None, None)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 3), ("empty", 0.1, 1), ("zero", 0.0, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mixture(docs, targets).collect()
    most = {"big": 1, "small": 2, "tiny": 3}
    assert {r["source"] for r in mixed} == set(most) and all(0 <= r["uses"] <= most[r["source"]] for r in mixed)
    assert all(abs(r["uses"] - r["expected_uses"]) < 1 for r in mixed)
    shares = {r["source"]: r["actual_share"] for r in mixing.shares(docs, targets).collect()}
    assert shares["big"] == pytest.approx(0.5, abs=0.01) and shares["tiny"] == pytest.approx(0.2, abs=0.01) and shares["empty"] == 0
    assert mixing.mixture(docs.limit(0), targets).count() == 0
    given = mixing.mixture(docs, targets, language_shares={"en": 0.5, "de": 0.25, "und": 0.25}).collect()
    assert sum(r["uses"] * r["n_tokens"] for r in given) > 0


PEOPLE = [(g, f) for g, f in zip("Ketzia Liskara Ada Bo Cy Di Eve Finn Gil".split(), "Dunnaquist Ferriquist Dunnavar Ferrivar Hexenquist Hexenvar Ferrimere Dunnamere Hexenmere".split())]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Mail ann (at) corp [dot] example, or bob at example dot org.", [("email", "ann (at) corp [dot] example"), ("email", "bob at example dot org")]),
        ("аnn@exаmple.com wrote <x.y+z@a-b.co.uk>.", [("email", "аnn@exаmple.com"), ("email", "x.y+z@a-b.co.uk")]),
        ("Clone git@git.example.test:tools/2.git, pin @scope/x@1.2.3", []),
        ("Ring five five five zero one zero zero one two three now", [("phone", "five five five zero one zero zero one two three")]),
        ("Call +49 30 23125 451, (586) 555-0132 (ext. 4), 01632 960187 or 0044 1632 960238.", [("phone", "+49 30 23125 451"), ("phone", "(586) 555-0132"), ("phone", "01632 960187"), ("phone", "0044 1632 960238")]),
        ("Host 10.20.31.7, version 12.555.01, checksum 657-29-59, epoch 1732550150, 2026-03-14T09:62:00Z", []),
        ("SSN# 925-81-5247 and passport no. X 4241032, tax id 83/287/67789, (997-69-9572)", [("identity", "925-81-5247"), ("identity", "X 4241032"), ("identity", "83/287/67789"), ("identity", "997-69-9572")]),
        ("At 12B Elm Street, 16 rue de Quillridge, Calle Luna 33 and Hauptstr. 5.", [("address", "12B Elm Street"), ("address", "16 rue de Quillridge"), ("address", "Calle Luna 33"), ("address", "Hauptstr. 5")]),
        ("Dr. Zed Ferrivar, Dunnamere, Ketzia, K. Hexenquist and ADA FERRIMERE; Redwood Cache", [("name", "Zed Ferrivar"), ("name", "Dunnamere, Ketzia"), ("name", "K. Hexenquist"), ("name", "ADA FERRIMERE")]),
        ("as ketzia dunnaquist noted, raised by k. hexenmere, dunnamere, ada; by Dunnamere", [("name", "ketzia dunnaquist"), ("name", "k. hexenmere"), ("name", "dunnamere, ada")]),
        ("", []),
    ],
)
def test_pii(text, want):
    spans = pii.detect(text, pii.Names(PEOPLE))
    assert [(k, text[s:e]) for s, e, k in spans] == want
    assert len(re.findall(r"\[[A-Z]+\]", pii.replaced(text, spans))) == len(want)


@pytest.mark.parametrize(
    "text,want",
    [
        ("415-555-0100 212-555-0199", ["phone 415-555-0100", "phone 212-555-0199"]),
        ("(415) 555-0100 (212) 555-0199", ["phone (415) 555-0100", "phone (212) 555-0199"]),
        ("020 7946 0958 / 020 7946 0959", ["phone 020 7946 0958", "phone 020 7946 0959"]),
        ("123-45-6789 987-65-4321", ["identity 123-45-6789", "identity 987-65-4321"]),
        ("123-45-6789 415-555-0100", ["identity 123-45-6789", "phone 415-555-0100"]),
        ("415-555-0100 123-45-6789", ["phone 415-555-0100", "identity 123-45-6789"]),
        ("SSN 123-45-6789 987-65-4321 or 415-555-0100 212-555-0199 646-555-0101.", ["identity 123-45-6789", "identity 987-65-4321", "phone 415-555-0100", "phone 212-555-0199", "phone 646-555-0101"]),
        ("passport X4241032 415-555-0100, tel 5550100 123-45-6789", ["identity X4241032", "phone 415-555-0100", "phone 5550100", "identity 123-45-6789"]),
    ],
)
def test_numbers_side_by_side(text, want):
    spans = pii.detect(text, pii.Names(PEOPLE))
    assert [f"{k} {text[s:e]}" for s, e, k in spans] == want
    assert not re.search(r"\d", pii.replaced(text, spans))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Raised by Priya Raman, thanks to Hannah Whitfield. Ms. Okafor Lindqvist said so.", ["name Priya Raman", "name Hannah Whitfield", "name Okafor Lindqvist"]),
        ("then Ketzia Whitfield and Ada Okonkwo met; Redwood Cache, Grand Central and Ada Street stay", ["name Ketzia Whitfield", "name Ada Okonkwo"]),
        ("Best regards,\nTomas Albrecht", ["name Tomas Albrecht"]),
        ("Ring 555 one two three four or call double five five one two triple three", ["phone 555 one two three four", "phone double five five one two triple three"]),
        ("one two three steps, 20 one two", []),
        ("𝐚𝐧𝐧@𝐜𝐨𝐫𝐩.𝐨𝐫𝐠 and αnn@ехаmple.сom", ["email 𝐚𝐧𝐧@𝐜𝐨𝐫𝐩.𝐨𝐫𝐠", "email αnn@ехаmple.сom"]),
        ("to " + "a.b" * 70 + "@example.org now", ["email " + "a.b" * 70 + "@example.org"]),
        ("git@" + "host" * 30 + ".org:" + "path/" * 30 + "x.git", []),
        ("passport number" + " " * 90 + ": X4241032", ["identity X4241032"]),
        ("at " + "Lang" + "e" * 60 + "straße 12", ["address Lang" + "e" * 60 + "straße 12"]),
        ("as ketzia" + "x" * 40 + " dunnaquist noted", ["name ketzia" + "x" * 40 + " dunnaquist"]),
    ],
)
def test_items_without_a_fixed_distance(text, want):
    spans = pii.detect(text, pii.Names(PEOPLE))
    assert [f"{k} {text[s:e]}" for s, e, k in spans] == want


def test_families_are_known_by_their_sequences():
    names = pii.Names(PEOPLE)
    assert names.is_family("Hexenvar") and names.is_family("dunnavar") and not names.is_family("variable") and not names.is_family("Whitfield")


def test_many_items_are_kept_apart():
    text = " ".join(f"a{i}@b.org and 415-555-{i:04d}" for i in range(3000))
    assert len(pii.detect(text, pii.Names(PEOPLE))) == 6000


@pytest.mark.parametrize("text", ["jane@example[.]com", "jane[@]example.com", "jane(@)example.com", "jane@example(.)com"])
def test_bracketed_signs_alone_open_the_gate(text):
    source = f"Mail {text} today"
    assert [(k, source[s:e]) for s, e, k in pii.detect(source, pii.Names(PEOPLE))] == [("email", text)]


def test_spans_map_back():
    n = pii.normalised("x a (at) b [dot] co y")
    i = n.text.index("a@b.co")
    assert n.source[slice(*n.span(i, i + 6))] == "a (at) b [dot] co"


def test_pii_tables(spark):
    docs = spark.createDataFrame([(1, "to a@b.org and a@b.org", "x"), (2, None, "x"), (3, "", "x"), (None, "a@b.org", "x")], "doc_id long, text string, pii_kind string")
    roster = spark.createDataFrame([("Ada", None), (None, None)], "given_name string, family_name string")
    assert [tuple(r) for r in pii.found(docs, roster).collect()] == [(1, "email", "a@b.org")]
    assert {r["doc_id"]: (r["text"], r["n_found"]) for r in pii.redacted(docs, roster).collect()} == {1: ("to [EMAIL] and [EMAIL]", 2), 2: (None, 0), 3: ("", 0)}
    assert pii.found(docs.limit(0), roster.limit(0)).count() == 0
