"""Text primitives as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.fixed import COMMANDS, ERROR_WORDS, INTENT_STOP_WORDS, SOUNDEX_DIGITS, SOUNDEX_LETTERS, SUFFIXES, TAG_STOP_WORDS, VERB_LIKE

#: Any white space, Unicode's included.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKEN, WORD = r"[\p{L}\p{N}_]{3,}", r"[\p{L}\p{N}_]+"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tags_text(tags: Column) -> Column:
    """Tags in one string; null elements count as empty ones."""
    return F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ", "")


def found_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(group))


def tokens(c: Column) -> Column:
    """Distinct search tokens: words of three or more characters, lower-cased, in order of appearance."""
    return F.array_distinct(found_all(F.lower(c), TOKEN))


def word_set(c: Column) -> Column:
    """Distinct words of any length, for Jaccard similarities."""
    return F.array_distinct(found_all(F.lower(c), WORD))


def searchable(content: Column, tags: Column, kind: Column, section: Column | None = None) -> Column:
    parts = [text(content), tags_text(tags), text(kind)] + ([text(section)] if section is not None else [])
    return F.concat_ws(" ", *parts)


def stem_sql(w: str) -> str:
    """Suffix stripping; the first suffix that leaves three letters goes.  Standard SQL for any engine."""
    cases = " ".join(f"when {w} like '%{s}' and length({w}) >= {len(s) + 3} then substring({w}, 1, length({w}) - {len(s)})" for s in SUFFIXES)
    return f"case when length({w}) <= 4 then {w} {cases} when {w} like '%s' and {w} not like '%ss' then substring({w}, 1, length({w}) - 1) else {w} end"


def stem(w: str) -> Column:
    return F.expr(stem_sql(w))


def soundex(w: Column) -> Column:
    """American Soundex in which vowels and digits do not part equal codes; empty for one letter or no leading letter."""
    up = F.upper(w)
    first = F.substring(up, 1, 1)
    digits = F.regexp_replace(F.translate(F.regexp_replace(up, "[0-9]", ""), SOUNDEX_LETTERS, SOUNDEX_DIGITS), "[^1-6]", "")
    for d in "123456":
        digits = F.regexp_replace(digits, f"{d}+", d)
    own = F.instr(F.lit(SOUNDEX_LETTERS), first) > 0
    rest = F.when(own, F.substring(digits, 2, 100)).otherwise(digits)
    return F.when((F.length(w) < 2) | ~first.rlike(r"^\p{L}"), "").otherwise(F.rpad(F.concat(first, F.substring(rest, 1, 3)), 4, "0"))


def split_words(c: Column) -> Column:
    return F.filter(F.split(text(c), SPACE + "+"), lambda w: w != "")


def worth_storing(c: Column) -> Column:
    """A whole sentence: five words, three different ones of over three letters, no lower-case start but a command's."""
    ws = split_words(c)
    telling = F.array_distinct(F.transform(F.filter(ws, lambda w: F.length(w) > 3), lambda w: F.lower(w)))
    start = ~text(c).rlike(r"^\p{Ll}") | text(c).rlike("^(?:" + "|".join(COMMANDS) + ")")
    return (F.size(ws) >= 5) & (F.size(telling) >= 3) & start


def worth_surfacing(c: Column) -> Column:
    return (F.length(text(c)) >= 20) & worth_storing(c)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two distinct arrays; 0 where one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def content_hash(c: Column) -> Column:
    return F.substring(F.md5(F.lower(c)), 1, 16)


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^{SPACE}+|{SPACE}+$", "")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(strip(c), SPACE + "+", " ")


def intent(prompt: Column) -> Column:
    """Keywords of a prompt without long quotes and code, or its first 50 characters where there are none."""
    plain = F.regexp_replace(F.regexp_replace(text(prompt), '"[^"]{20,}"', " "), r"```[\s\S]{20,}?```", " ")
    words = F.split(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_\-]", " "), " +")
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(strings(INTENT_STOP_WORDS), w)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.substring(strip(prompt), 1, 50))


def smart_tags(content: Column, prompt: Column) -> Column:
    """The first eight telling lower-case words of a correction and its prompt."""
    both = F.lower(F.concat_ws(" ", text(content), text(prompt)))
    words = found_all(both, r"(?U)\b[a-z][a-z0-9_-]{2,}\b")
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(strings(TAG_STOP_WORDS), w))), 1, 8)


def contains_any(c: Column, values: list[str]) -> Column:
    found = F.lit(False)
    for v in values:
        found = found | F.contains(c, F.lit(v))
    return found


def verb_like(c: Column) -> Column:
    return text(c).rlike(rf"(?i)[\p{{L}}\p{{N}}_](?:{VERB_LIKE})(?:[^\p{{L}}\p{{N}}_]|$)")


def error_line(output: Column) -> Column:
    """The first line with an error word, else the last line with anything in it; 120 characters of it."""
    lines = F.filter(F.transform(F.split(text(output), "\n"), strip), lambda x: x != "")
    bad = F.filter(lines, lambda x: x.rlike("|".join(ERROR_WORDS)))
    line = F.coalesce(F.get(bad, F.lit(0)), F.try_element_at(lines, F.lit(-1)), F.lit("no output"))
    return F.substring(line, 1, 120)


def file_name(path: Column) -> Column:
    return F.substring_index(F.substring_index(text(path), "/", -1), "\\", -1)


def preview(c: Column) -> Column:
    """The first two lines in one, 150 characters of them, with dots where the content is longer."""
    head = F.substring(F.array_join(F.slice(F.split(text(c), "\n"), 1, 2), " "), 1, 150)
    return F.concat(head, F.when(F.length(text(c)) > 150, "...").otherwise(""))


ISO = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(Z|[+-]\d{2}:\d{2})?$"


def iso_time(c: Column) -> Column:
    """ISO text as a timestamp; without a zone it is UTC; anything else is null."""
    return F.when(c.rlike(ISO), F.try_to_timestamp(F.concat(F.regexp_extract(c, ISO, 1), F.when(F.regexp_extract(c, ISO, 2).isin("", "Z"), "+00:00").otherwise(F.regexp_extract(c, ISO, 2)))))


def age_days(when: Column, now: str) -> Column:
    """Days since then; 0 for the future and for null."""
    micros = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(when)
    return F.coalesce(F.greatest(micros / F.lit(86400e6), F.lit(0.0)), F.lit(0.0))
