import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "word,stem",
    [("this", "this"), ("deployment", "deploy"), ("nation", "nation"), ("running", "run"), ("entries", "entr"), ("class", "class"), ("tables", "tabl"), ("docks", "dock"), ("used", "used"), ("timed", "tim")],
)
def test_stem(spark, word, stem):
    assert one(spark, T.stem("w"), w=word) == stem


@pytest.mark.parametrize("word,code", [("k8s", "K000"), ("tymczak", "T520"), ("sases", "S000"), ("robert", "R163"), ("kubernetes", "K165"), ("8ab", ""), ("a", "")])
def test_soundex(spark, word, code):
    assert one(spark, T.soundex(F.col("w")), w=word) == code


@pytest.mark.parametrize(
    "content,surfacing,storing",
    [
        ("Keep the builder small and quick", True, True),
        ("keep the builder small and quick", False, False),
        ("npm runs the builder twice after login", True, True),
        ("Only four words here", False, False),
        ("Ab cd ef gh ij kl", False, False),
        (None, False, False),
        ("", False, False),
    ],
)
def test_quality_gate(spark, content, surfacing, storing):
    assert one(spark, T.worth_surfacing(F.col("c")), c=content) is surfacing
    assert one(spark, T.worth_storing(F.col("c")), c=content) is storing


def test_tokens_are_unicode_and_distinct(spark):
    assert one(spark, T.tokens(F.col("c")), c="Über über ab_c x1 naïve-Test") == ["über", "ab_c", "naïve", "test"]
    assert one(spark, T.tokens(F.col("c")), c=None) == []


def test_jaccard(spark):
    a, b = F.split("a", " "), F.split("b", " ")
    assert one(spark, T.jaccard(a, b), a="x y z", b="y z w") == 0.5
    assert one(spark, T.jaccard(F.filter(a, lambda w: w != ""), b), a="", b="y") == 0.0


def test_intent(spark):
    assert one(spark, T.intent(F.col("p")), p='Please fix the parser, "a quote that is long enough to go" parser tests') == "fix parser tests"
    assert one(spark, T.intent(F.col("p")), p="  so it is  ") == "so it is"


def test_error_line_and_preview(spark):
    assert one(spark, T.error_line(F.col("o")), o="one\n  bad Error here \nlast") == "bad Error here"
    assert one(spark, T.error_line(F.col("o")), o="one\nlast\n\n") == "last"
    assert one(spark, T.error_line(F.col("o")), o=None) == "no output"
    assert one(spark, T.preview(F.col("c")), c="a\nb\nc") == "a b"
    assert one(spark, T.preview(F.col("c")), c="x" * 151) == "x" * 150 + "..."


@pytest.mark.parametrize(
    "text,age",
    [("2026-10-31T00:00:00Z", 1.0), ("2026-10-31T12:00:00", 0.5), ("2026-10-31T05:30:00+05:30", 1.0), ("2027-01-01T00:00:00Z", 0.0), ("yesterday", 0.0), ("2026-13-40T00:00:00Z", 0.0), (None, 0.0)],
)
def test_age(spark, text, age):
    assert one(spark, T.age_days(T.iso_time(F.col("t")), "2026-11-01T00:00:00Z"), t=text) == age


def test_smart_tags(spark):
    assert one(spark, T.smart_tags(F.col("c"), F.col("p")), c="Use the Red-parser now", p="é3 parser x") == ["red-parser", "now", "parser"]
