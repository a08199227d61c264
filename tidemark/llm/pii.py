"""Personal information in free text: offset-preserving deobfuscation, detection, typed placeholders.

A text passes through transducers that each keep, for every character they write, the source characters
it stands for:

  homoglyphs      letters of other scripts that look like ASCII, and compatibility forms (full width, mathematical,
                  circled), one for one
  spelled digits  runs of digit words, also with "double" and "triple" and among figures, become digits
  at and dot      "(at)", "[dot]", " @ " and "x at y dot z" become signs

Detectors run on the normalised text; their spans are mapped back, so what is reported and replaced is the
source as written.  Nothing is looked for within a fixed distance: items and what stands before them are followed to
their ends, however long.

Names are known by evidence for the two words of a pair: given and family names of the roster; words most of whose
three-letter sequences are those of its family names; titles and other signs that a person is named; and for a family name
never seen, a known given name before it.  A pair of unknown words without a sign is not taken for a name.

The work is one pass over the documents in Arrow batches, whole texts, nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[IDENTITY]", "address": "[ADDRESS]", "name": "[NAME]"}

# Letters that look like ASCII ones: Cyrillic, Greek, then the dashes.
_LOOK_ALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTYXIJS"))
_LOOK_ALIKES |= dict(zip("кѵɡıɑօոսհαικνρτυωϲϳ", "kvgiaonuhaikvptuwcj"))
_LOOK_ALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo")) | dict.fromkeys("‐‑‒–−", "-") | {" ": " ", " ": " ", " ": " "}
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_STREETS = "Street|St\\.|St|Avenue|Ave\\.|Ave|Road|Rd\\.|Rd|Lane|Ln\\.|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd\\.|Blvd|Way|Terrace|Place|Square|Close|Crescent|Parkway|Highway"
_STREETS_BEFORE = "Calle|Plaza|Avenida|Paseo|Via|Piazza|Camino|Carrer"
_STREETS_JOINED = ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "damm", "ufer", "ring")
_NOT_GIVEN = frozenset("The A An Ask Ping By From To For And Or But If In On At Is Was Mr Mrs Ms Dr Prof Regards Thanks Hi Hello Dear Team Owner Name".split())
_SMALL_WORDS = frozenset("that from with says said thanks name this reviewed raised paired reported signed noted ask ping dear".split())
_LABELS = r"(?:ssn|soc(?:ial)?\.? sec(?:urity|\.)?(?: (?:number|no\.?))?|passport(?: (?:number|no\.?))?|(?:national|personal|identity|id)(?: card)?(?: (?:id|number|no\.?))?|tax(?:payer)?[ -]?(?:id|number|no\.?)|tin|nif|dni|nin)"


class _Plain(dict):
    """For str.translate: look-alikes, and characters whose compatibility form is one ASCII character."""

    def __missing__(self, code: int) -> int | str:
        form = unicodedata.normalize("NFKC", chr(code))
        self[code] = form if len(form) == 1 and form.isascii() else code
        return self[code]


_TABLE = _Plain({ord(a): b for a, b in _LOOK_ALIKES.items()})
_WORD = "|".join(_DIGIT_WORDS)
_TIMES = {"double": 2, "triple": 3}
_ITEM = rf"(?:(?:double|triple) )?(?:{_WORD})\b"
_SPELLED = re.compile(rf"(?<![\w.\-/])(?:{_ITEM}|\d+)(?:[ \-,]+(?:{_ITEM}|\d+(?!\w)))+", re.I)
_SPELLED_ITEM = re.compile(rf"(?:(double|triple) )?({_WORD}|\d+)([ \-,]*)", re.I)
_SPELLED_HINT = re.compile(rf"(?:{_WORD})[ \-,]+(?:{_ITEM})[ \-,]+(?:{_WORD}|double|triple)|(?:double|triple) (?:{_WORD})")  # of lower-cased texts
_SIGNS = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|(?<=\w) @ (?=\w)", re.I)
_SPOKEN = re.compile(r"(?<![\w@])[\w+\-]+(?:(?: dot |\.)[\w+\-]+)* at [\w\-]+(?:(?: dot )[\w\-]+)+(?!\w)", re.I)
_HINT_AT = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]| dot ", re.I)
_HINT_SPOKEN = re.compile(r" at \S+ dot ", re.I)


class Normal:
    """A normalised text and the way back to its source."""

    def __init__(self, source: str):
        self.source = self.text = source
        self.at: list[int] = []  # where pieces begin in text
        self.piece: list[tuple[int, int, bool]] = []  # their source spans; whether they are copied one for one

    def replaced(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, new) of the source."""
        out, pos, here = [], 0, 0
        for start, end, new in sorted(edits):
            if start < pos:
                continue
            for a, b, s, same in ((pos, start, self.source[pos:start], True), (start, end, new, False)):
                if s:
                    self.at.append(here)
                    self.piece.append((a, b, same))
                    out.append(s)
                    here += len(s)
            pos = end
        self.at.append(here)
        self.piece.append((pos, len(self.source), True))
        out.append(self.source[pos:])
        self.text = "".join(out)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the text."""
        if not self.at:
            return start, end
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, _, same = self.piece[i]
        first = a + (start - self.at[i] if same else 0)
        a, b, same = self.piece[j]
        return first, a + (end - self.at[j]) if same else b


def normalised(source: str) -> Normal:
    plain = source if source.isascii() else source.translate(_TABLE)  # one for one: offsets stay
    edits: list[tuple[int, int, str]] = []
    if " @ " in plain or _HINT_AT.search(plain):
        for m in _SIGNS.finditer(plain):
            edits.append((m.start(), m.end(), "@" if "@" in m[0] or "at" in m[0].lower() else "."))
        for m in _SPOKEN.finditer(plain) if _HINT_SPOKEN.search(plain) else ():
            for w in re.finditer(r" (at|dot) ", m[0], re.I):
                edits.append((m.start() + w.start(), m.start() + w.end(), "@" if w[1].lower() == "at" else "."))
    if _SPELLED_HINT.search(plain.lower()):
        for m in _SPELLED.finditer(plain):
            items = list(_SPELLED_ITEM.finditer(plain, m.start(), m.end()))
            digits = [(_DIGIT_WORDS.get(i[2].lower(), i[2])) * _TIMES.get((i[1] or "").lower(), 1) for i in items]
            spelled = sum(len(d) for i, d in zip(items, digits) if not i[2].isdigit())
            if spelled >= 3 and sum(map(len, digits)) >= 5 and (spelled >= 5 or sum(map(len, digits)) >= 7):
                for k, (i, d) in enumerate(zip(items, digits)):
                    edits.append((i.start(), i.end() if k + 1 < len(items) else i.end(2), d))
    n = Normal(plain)
    if edits:
        n.replaced(edits)
    n.source = source
    return n


_DOMAIN = re.compile(r"[A-Za-z0-9](?:[\w\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![\w\-])")
_REMOTE = re.compile(r"[:/][\w~./\-]+")


def _back(t: str, end: int, more: str) -> int:
    """Where the run of letters, digits and the given characters before a place begins."""
    while end and (t[end - 1].isalnum() or t[end - 1] in more):
        end -= 1
    return end


def _emails(t: str) -> Iterator[tuple[int, int]]:
    at = t.find("@")
    while at >= 0:
        start, domain = _back(t, at, "_.+-'"), _DOMAIN.match(t, at + 1)
        while start < at and not (t[start].isascii() and t[start].isalnum()):
            start += 1
        if start < at and domain and not _REMOTE.match(t, domain.end()) and not t[max(0, start - 3) : start].endswith(("://", "@", "/")):
            yield start, domain.end()
        at = t.find("@", at + 1)


_RUN = re.compile(r"(?<![\w.\-/:@#])(?:[A-Z]{1,2} ?(?=\d{6}))?[+(]?\d[\d .\-/()]{4,24}\d(?![\w@])|(?<=[#=:])\d[\d .\-/]{6,20}\d(?!\w)")
_EDGES = r"(?<![\w.\-/+])", r"(?![\w@]|[.\-/]\d)"
_PHONES = [
    (re.compile(_EDGES[0] + r"(?:\+|00)[1-9]\d{0,2}[ .\-]?(?:\(0?\d{0,4}\)[ .\-]?)?\d{1,5}(?:[ .\-/]?\d{2,5}){1,5}" + _EDGES[1]), 9, 15),
    (re.compile(_EDGES[0] + r"(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[.\- ]\d{4}" + _EDGES[1]), 10, 11),
    (re.compile(_EDGES[0] + r"(?:\(0\d{1,4}\) ?|0\d{1,4}[ .\-/])\d{2,6}(?:[ .\-/]\d{2,6}){0,4}" + _EDGES[1]), 9, 12),
    (re.compile(_EDGES[0] + r"0\d{9,10}" + _EDGES[1]), 10, 11),
]
_CALL = re.compile(r"(?:tel|phone|mobile|cell|call|ring|dial|fax|desk at|reach \w+ at)$", re.I)
_BARE = re.compile(r"\d{7,11}(?!\w)")
_SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")
_LABELLED = re.compile(_LABELS + "$", re.I)
#: No label or sign of a call is longer.
_LONGEST_LABEL = 60
_NUMBERS = re.compile(r"(?:[A-Z]{1,2} ?)?\d{2,}(?:[ \-/]?\d{2,}){0,4}|[A-Z] ?\d{6,9}")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _number(t: str, start: int, end: int) -> tuple[int, int, str] | None:
    """An identity or phone number of a digit run, by its shape and what stands before it."""
    low = start
    while low and (t[low - 1].isspace() or t[low - 1] in "#:.="):
        low -= 1
    # a label ends in its own dot, or before what parts it from the number
    if any(_LABELLED.search(t, max(0, at - _LONGEST_LABEL), at) for at in {low, min(low + 1, start)}):
        m = _SSN.match(t, start, end) or _NUMBERS.match(t, start, end)
        if m and _digits(m[0]) >= 6:
            # what has a blank before it and a shape of its own is another number
            for shape in (_SSN, _PHONES[1][0]):
                other = shape.search(t, m.start() + 6, end)
                if other and other.start() < m.end() and t[other.start() - 1] == " " and _digits(t[m.start() : other.start()]) >= 6:
                    return m.start(), other.start() - 1, "identity"
            return m.start(), m.end(), "identity"
    m = _SSN.search(t, start, end)
    if m:
        return m.start(), m.end(), "identity"
    for shape, least, most in _PHONES:
        m = shape.search(t, start, min(len(t), end + 2))
        if m and m.end() <= end and least <= _digits(m[0]) <= most:
            return m.start(), m.end(), "phone"
    m = _BARE.match(t, start, end + 1)
    if not m or m.end() != end:
        return None
    low = start
    while low and (t[low - 1].isspace() or t[low - 1] in ":.=\"'"):
        low -= 1
    head = _back(t, low, "_")
    if t[head:low].lower() == "at":  # "desk at", "reach somebody at"
        for _ in range(2):
            head = _back(t, head - 1, "_") if t[head - 1 : head] == " " else head
    return (start, end, "phone") if _CALL.search(t, head, low) else None


def _numbers(t: str) -> Iterator[tuple[int, int, str]]:
    """Identity and phone numbers in digit runs.  A run may hold several: what is before a number is searched as a run of its
    own, and runs go on from its end."""
    at = 0
    while run := _RUN.search(t, at):
        start, end = run.span()
        at = 0
        while found := _number(t, start, end):
            yield found
            at = max(at, found[1])
            end = start + len(t[start : found[0]].rstrip(" .-/("))
            if end - start < 6:
                break
        at = at or run.end()


_CAP = r"[A-ZÀ-Þ][\w'’\-]*"
_ADDRESSES = [
    re.compile(rf"(?<![\w.\-/])\d{{1,5}}[A-Za-z]? (?:(?:{_CAP}) ){{1,3}}(?:{_STREETS}|{_STREETS.upper()})(?!\w)"),
    re.compile(rf"(?<![\w.\-/])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:[Rr]ue|RUE|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Qq]uai) (?:(?:de la|de l'|de|du|des|d'|DE|DU|DES) ?)?{_CAP}(?: {_CAP})?"),
    re.compile(rf"(?<!\w)(?:{_STREETS_BEFORE}|{_STREETS_BEFORE.upper()}) (?:(?:de|del|de la|de los|DE|DEL) )?{_CAP},? \d{{1,4}}[A-Za-z]?(?!\w)"),
]
_HOUSE = re.compile(r" \d{1,4}[a-zA-Z]?(?!\w)")
_STREET_WORD = re.compile(r"[A-ZÄÖÜ][\w\-]*\.?")
_STREET_FIRST = re.compile(r"[A-ZÄÖÜ][\w\-]+")


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    for shape in _ADDRESSES:
        for m in shape.finditer(t):
            yield m.span()
    for m in _HOUSE.finditer(t):
        end = m.start()
        ending = next((e for e in _STREETS_JOINED if t[max(0, end - 8) : end].lower().endswith(e)), None)
        if not ending:
            continue
        start = _back(t, end - (t[end - 1] == "."), "_-")
        word = t[start:end]
        if not _STREET_WORD.fullmatch(word):
            continue
        if len(word) >= len(ending) + 3:
            yield start, m.end()
        elif ending != "ring" and len(word) == len(ending) and t[max(0, start - 1) : start] == " ":
            first = _back(t, start - 1, "_-")
            if _STREET_FIRST.fullmatch(t[first : start - 1]):
                yield first, m.end()


def _sequences(word: str) -> list[str]:
    return [f"^{word}$"[i : i + 3] for i in range(len(word))]


class Names:
    """Given and family names of a roster, and what its family names look like."""

    #: Share of the three-letter sequences of a word that must be those of two or more family names, and its least length.
    ALIKE, LEAST = 0.7, 6

    def __init__(self, people: Iterable[tuple[str | None, str | None]]):
        people = [(g or "", f or "") for g, f in people]
        self.given = {g.lower() for g, _ in people if len(g) > 1}
        self.family = {f.lower() for _, f in people if len(f) > 1}
        seen: dict[str, int] = defaultdict(int)
        for f in self.family:
            for q in set(_sequences(f)):
                seen[q] += 1
        self.sequences = {q for q, n in seen.items() if n >= 2}
        self.known: dict[str, bool] = {}
        heads = sorted({f[:4] for f in self.family})
        self.lower = re.compile("(?:" + "|".join(map(re.escape, heads)) + r")[\w'’]*") if heads else None

    def is_family(self, word: str) -> bool:
        """Whether a word is a family name of the roster or made of the same sequences."""
        w = word.lower()
        got = self.known.get(w)
        if got is None:
            got = w in self.family
            if not got and len(w) >= self.LEAST and self.sequences:
                parts = _sequences(w)
                got = parts[0] in self.sequences and parts[-1] in self.sequences and sum(q in self.sequences for q in parts) >= self.ALIKE * len(parts)
            if len(self.known) < 100_000:
                self.known[w] = got
        return got

    def is_given(self, word: str) -> bool:
        return word.lower() in self.given


_AFTER = re.compile(r", ([a-z]+)(?![\w@])")
_PART = r"[A-ZÀ-Þ][a-zà-ÿ'’]+|[A-ZÀ-Þ]{2,}"
_PAIR = re.compile(rf"(?<![\w.@\-/])({_PART}|[A-ZÀ-Þ]\.)(,? )(?=({_PART})(?![\w@]|\.\w))")
_TITLE = re.compile(
    r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? |\b[Mm]y name is |\bName: |\bReported-by: |\bFrom: |\bsigned off: |\bassignee = "
    r"|\b(?:[Rr]egards|[Tt]hanks|[Ss]incerely|[Cc]heers),\s|\b(?i:reviewed|raised|reported|written|approved|signed|requested|owned) by |\b(?i:paired|met|spoke) with |\b[Tt]hanks to |\bcc )$"
)
#: No title or sign of a person is longer.
_LONGEST_TITLE = 20
_NO_FAMILY = frozenset((_STREETS.replace("\\", "").replace(".", "") + "|" + _STREETS_BEFORE).split("|"))


def _unknown(a: str, b: str, names: Names) -> bool:
    """Whether two words could be a name nobody has told of: both written like names, neither a word that begins sentences."""
    return a.istitle() and b.istitle() and len(a) > 1 and len(b) > 2 and not {a, b} & _NOT_GIVEN and b not in _NO_FAMILY and a not in _NO_FAMILY and not names.is_given(b)


def _names(t: str, names: Names) -> Iterator[tuple[int, int]]:
    for m in _PAIR.finditer(t):
        a, gap, b = m[1], m[2], m[3]
        if gap == " ":
            if names.is_family(b):
                ok = a.endswith(".") or a not in _NOT_GIVEN and not names.is_family(a)
            else:
                # a family name never seen: a known given name, or a sign of a person, stands before it
                told = _TITLE.search(t, max(0, m.start() - _LONGEST_TITLE), m.start())
                if a.endswith("."):
                    ok = bool(told) and b.istitle() and b not in _NOT_GIVEN and b not in _NO_FAMILY
                elif names.is_given(a):
                    ok = _unknown(a, b, names) or bool(told) and b not in _NOT_GIVEN
                else:
                    ok = bool(told) and _unknown(a, b, names)
        else:
            ok = not a.endswith(".") and names.is_family(a) and (names.is_given(b) or b not in _NOT_GIVEN and b.istitle() and not names.is_family(b))
        if ok:
            yield m.start(), m.end(3)
    for m in names.lower.finditer(t) if names.lower else ():  # the same in small letters
        if not names.is_family(m[0]) or t[m.end() : m.end() + 1] == "@":
            continue
        at, after = m.start(), _AFTER.match(t, m.end())
        first = _back(t, at - 1 - (t[at - 2 : at - 1] == "."), "_") if t[at - 1 : at] == " " else at
        before = t[first : at - 1] if first < at - 1 and t[max(0, first - 1) : first] not in {".", "@", "-", "/"} else ""
        initial = len(before) == 2 and before[1] == "." and before[0].islower()
        if initial or before.isascii() and before.isalpha() and before.islower() and (names.is_given(before) or before not in _SMALL_WORDS and len(before) > 3):
            yield first, m.end()
        elif after and names.is_given(after[1]) and not t[at - 1 : at].strip():
            yield at, after.end(1)


def detect(source: str, names: Names) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the source, in order and apart from each other."""
    n = normalised(source)
    found = [(0, *s, "email") for s in _emails(n.text)]
    for s, e, kind in _numbers(n.text):
        found.append((1 if kind == "identity" else 3, s, e, kind))
    found += [(2, *s, "address") for s in _addresses(n.text)]
    found += [(4, *s, "name") for s in _names(n.text, names)]
    starts: list[int] = []  # of the spans taken, in order
    taken: list[tuple[int, int, str]] = []
    for _, start, end, kind in sorted(found):
        i = bisect_right(starts, start)
        if (not i or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
            starts.insert(i, start)
            taken.insert(i, (start, end, kind))
    return [(*n.span(s, e), kind) for s, e, kind in taken]


def replaced(source: str, spans: list[tuple[int, int, str]]) -> str:
    out, pos = [], 0
    for start, end, kind in spans:
        out += source[pos:start], PLACEHOLDERS[kind]
        pos = end
    return "".join([*out, source[pos:]])


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")


def _lexicon(roster: DataFrame):
    """The roster is a fixed list of people; it is read once on the driver."""
    people = [(r[0], r[1]) for r in roster.select("given_name", "family_name").distinct().collect()]
    return roster.sparkSession.sparkContext.broadcast(Names(people))


def found(documents: DataFrame, roster: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, found_text), each item once for a document.  Null and empty texts have none."""
    lexicon = _lexicon(roster)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = lexicon.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    rows += {(doc, kind, text[s:e]): None for s, e, kind in detect(text, names)}
            docs, kinds, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "pii_kind", "found_text"])

    return _rows(documents).mapInArrow(run, "doc_id long, pii_kind string, found_text string")


def redacted(documents: DataFrame, roster: DataFrame) -> DataFrame:
    """(doc_id, text, n_found): every document with placeholders; null texts stay null."""
    lexicon = _lexicon(roster)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = lexicon.value
        for b in batches:
            texts, counts = [], []
            for text in b.column(1).to_pylist():
                spans = detect(text, names) if text else []
                texts.append(replaced(text, spans) if spans else text)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_found"])

    return _rows(documents).mapInArrow(run, "doc_id long, text string, n_found int")
