"""The same queries as DuckDB statements over the same tables, written from the definitions, not from the plans.

Matching is done the plain way here: substrings by comparing every query token with every word, near duplicates by comparing
every pair, tails by a window over the whole log.
"""

from __future__ import annotations

from tidemark.config import DEFAULT
from tidemark.functions import fixed

#: White space of any script, for RE2; ISO times with an optional zone.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ISO = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?)(Z|[+-]\d\d:\d\d)?$"
FIX, GATE = DEFAULT.fix_seconds, DEFAULT.gate_seconds


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _stem(w: str) -> str:
    """The first suffix of the list that leaves three letters goes, else a single final s."""
    hit = f"list_filter([{_quoted(fixed.SUFFIXES)}], lambda suffix: ends_with({w}, suffix) AND length({w}) >= length(suffix) + 3)[1]"
    return f"CASE WHEN length({w}) <= 4 THEN {w} WHEN {hit} IS NOT NULL THEN left({w}, length({w}) - length({hit})) WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN left({w}, length({w}) - 1) ELSE {w} END"


def _portable(pattern: str) -> str:
    return pattern.replace("\\s", SPACE).replace("\\w", "[\\p{L}\\p{N}_]")


def _toks(e: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]{{3,}}'))"


def _words(e: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]+'))"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _any(e: str, values) -> str:
    return "(" + " OR ".join(f"contains({e}, {_lit(v)})" for v in values) + ")"


def _preview(c: str) -> str:
    lines = f"string_split({c}, chr(10))"
    return f"substring(array_to_string({lines}[1:2], ' '), 1, 150) || CASE WHEN length({c}) > 150 THEN '...' ELSE '' END"


_SPLIT = f"list_filter(string_split_regex(coalesce(content, ''), '{SPACE}+'), lambda w: w <> '')"
_STORING = (
    f"(len({_SPLIT}) >= 5 AND len(list_distinct(list_transform(list_filter({_SPLIT}, lambda w: length(w) > 3), lambda w: lower(w)))) >= 3"
    f" AND (NOT regexp_matches(coalesce(content, ''), '^\\p{{Ll}}') OR regexp_matches(coalesce(content, ''), '^(?:{'|'.join(fixed.COMMANDS)})')))"
)
_SURFACING = f"(length(coalesce(content, '')) >= 20 AND {_STORING})"
_HASH = "substring(md5(lower(content)), 1, 16)"
_TAGS = "array_to_string(list_transform(coalesce(tags, []), lambda t: coalesce(t, '')), ' ')"
_OFFSET = f"regexp_extract(logged_at, '{ISO}', 2)"
_MINUTES = f"CASE WHEN {_OFFSET} IN ('', 'Z') THEN 0 ELSE CAST(substring({_OFFSET}, 1, 1) || '1' AS INT) * (CAST(substring({_OFFSET}, 2, 2) AS INT) * 60 + CAST(substring({_OFFSET}, 5, 2) AS INT)) END"
_NOW = DEFAULT.now.rstrip("Z").replace("T", " ")
_AGE = f"coalesce(greatest((epoch_us(TIMESTAMP '{_NOW}') - (epoch_us(try_cast(regexp_extract(logged_at, '{ISO}', 1) AS TIMESTAMP)) - CAST({_MINUTES} AS BIGINT) * 60000000)) / 86400e6, 0.0), 0.0)"

_CORPUS = f"""
log0 AS (
  SELECT line_num AS entry_id, type AS kind, coalesce(content, '') AS content, {_TAGS} AS tags_text, CAST(NULL AS VARCHAR) AS section,
    0 AS priority, {_AGE} AS age_days, {_toks(f"coalesce(content, '') || ' ' || {_TAGS} || ' ' || coalesce(type, '')")} AS tokens
  FROM memory_log WHERE line_num IS NOT NULL),
core0 AS (
  SELECT core_id AS entry_id, type AS kind, coalesce(content, '') AS content, {_TAGS} AS tags_text, section,
    coalesce(priority, 0) AS priority, 0.0 AS age_days, {_toks(f"coalesce(content, '') || ' ' || {_TAGS} || ' ' || coalesce(type, '') || ' ' || coalesce(section, '')")} AS tokens
  FROM core_tagged WHERE core_id IS NOT NULL),
weights AS (
  SELECT token, count(*) AS df, ln(1 + (SELECT (SELECT count(*) FROM log0) + (SELECT count(*) FROM core0)) / count(*)) AS weight
  FROM (SELECT unnest(tokens) AS token FROM log0 UNION ALL SELECT unnest(tokens) FROM core0) GROUP BY token),
log AS (SELECT * FROM log0 WHERE {_SURFACING} AND len(tokens) > 0),
core AS (SELECT * FROM core0 WHERE {_SURFACING} AND len(tokens) > 0),
alias_pairs AS (SELECT DISTINCT alias_key AS token, alias FROM (SELECT alias_key, unnest(expansions) AS alias FROM aliases) WHERE alias_key IS NOT NULL AND alias IS NOT NULL)"""


def _intents(where: str) -> str:
    stops = _quoted(fixed.INTENT_STOP_WORDS)
    return f"""
iwords AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
    SELECT doc_id, string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace(text, '"[^"]{{20,}}"', ' ', 'g'), '```[\\s\\S]{{20,}}?```', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\-]', ' ', 'g'), ' +') AS ws
    FROM documents WHERE text IS NOT NULL AND {where})),
ikept AS (SELECT doc_id, w, min(p) AS p FROM iwords WHERE length(w) >= 3 AND w NOT IN ({stops}) GROUP BY doc_id, w),
itext AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS words FROM ikept GROUP BY doc_id),
intents AS (
  SELECT d.doc_id, d.session_id, d.text, coalesce(words, substring({_strip('d.text')}, 1, 50)) AS intent
  FROM documents d LEFT JOIN itext USING (doc_id) WHERE d.text IS NOT NULL AND {where.replace('doc_id', 'd.doc_id')}),
admitted AS (
  SELECT doc_id AS query_id, session_id, intent AS text FROM intents
  WHERE length(text) >= 15 AND NOT starts_with({_strip('text')}, '/') AND NOT starts_with(regexp_replace(text, '^{SPACE}+', ''), '{fixed.TASK_NOTIFICATION}')
    AND NOT {_any('substring(text, 1, 100)', fixed.SYSTEM_MARKERS)} AND length(intent) >= 3)"""


def _search(p: str, texts: str, entries: str, keep: int | None = 10, only_exact: bool = False, only_pairs: str | None = None) -> str:
    """CTEs {p}_q (query tokens), {p}_ev (evidence), {p}_scored and {p}_top (with rank, unlimited)."""
    within = f" SEMI JOIN {only_pairs} USING (query_id, entry_id)" if only_pairs else ""
    kinds = _quoted(fixed.PRIORITY_TYPES)
    more = "" if only_exact else f"""
  UNION
  SELECT query_id, entry_id, 's', {p}_st.stem, {p}_st.weight FROM {p}_st JOIN {p}_vocab v ON v.stem = {p}_st.stem JOIN {p}_post USING (token)
  UNION
  SELECT query_id, entry_id, 'p', n.token, n.weight FROM {p}_near n JOIN {p}_post o ON o.token = n.other"""
    return f"""
{p}_all AS (
  SELECT query_id, t.token, coalesce(w.weight, 1.0) AS weight, coalesce(w.weight, (SELECT max(weight) FROM weights), 1.0) AS rank_weight
  FROM (SELECT query_id, unnest({_toks('text')}) AS token FROM {texts}) t LEFT JOIN weights w USING (token)),
{p}_q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_weight DESC, token) AS place FROM {p}_all) WHERE place <= {keep or 10**9}),
{p}_post AS (SELECT entry_id, unnest(tokens) AS token FROM {entries}),
{p}_vocab AS (SELECT token, {_stem('token')} AS stem FROM (SELECT DISTINCT token FROM {p}_post)),
{p}_st AS (
  SELECT query_id, s.stem, coalesce(w.weight, 1.0) AS weight
  FROM (SELECT DISTINCT query_id, {_stem('token')} AS stem FROM {p}_q) s LEFT JOIN weights w ON w.token = s.stem),
{p}_pairs AS (
  SELECT q.token, v.token AS other FROM (SELECT DISTINCT token FROM {p}_q) q JOIN {p}_vocab v
  ON q.token <> v.token AND (contains(v.token, q.token) OR contains(q.token, v.token)) AND 2 * least(length(q.token), length(v.token)) >= greatest(length(q.token), length(v.token))),
{p}_near AS (
  SELECT q.query_id, q.token, q.weight, x.other FROM {p}_q q JOIN {p}_pairs x USING (token)
  WHERE NOT EXISTS (SELECT 1 FROM {p}_q o WHERE o.query_id = q.query_id AND o.token = x.other)),
{p}_ev AS (SELECT * FROM (
  SELECT query_id, entry_id, 'x' AS part, token, weight FROM {p}_q JOIN {p}_post USING (token)
  UNION
  SELECT query_id, entry_id, 'a', q.token, q.weight FROM {p}_q q JOIN alias_pairs a ON a.token = q.token JOIN {p}_post o ON o.token = a.alias{more}){within}),
{p}_exact AS (SELECT query_id, entry_id, token, max(weight) AS weight FROM {p}_ev WHERE part IN ('x', 'a') GROUP BY ALL),
{p}_sums AS (
  SELECT query_id, entry_id, sum(ew) AS ew, sum(n_exact) AS n_exact, sum(direct) AS direct, sum(sw) AS sw, sum(n_stem) AS n_stem, sum(only_w) AS only_w, sum(pw) AS pw FROM (
    SELECT query_id, entry_id, weight AS ew, 1 AS n_exact, 0 AS direct, 0.0 AS sw, 0 AS n_stem, 0.0 AS only_w, 0.0 AS pw FROM {p}_exact
    UNION ALL SELECT query_id, entry_id, 0, 0, 1, 0, 0, 0, 0 FROM {p}_ev WHERE part = 'x'
    UNION ALL SELECT query_id, entry_id, 0, 0, 0, weight, 1, 0, 0 FROM {p}_ev WHERE part = 's'
    UNION ALL SELECT query_id, entry_id, 0, 0, 0, 0, 0, weight, 0 FROM {p}_ev e WHERE part = 's'
      AND NOT EXISTS (SELECT 1 FROM {p}_exact x WHERE x.query_id = e.query_id AND x.entry_id = e.entry_id AND {_stem('x.token')} = e.token)
    UNION ALL SELECT query_id, entry_id, 0, 0, 0, 0, 0, 0, weight FROM {p}_ev e WHERE part = 'p'
      AND NOT EXISTS (SELECT 1 FROM {p}_exact x WHERE x.query_id = e.query_id AND x.entry_id = e.entry_id AND x.token = e.token)) GROUP BY ALL),
{p}_tot AS (SELECT query_id, sum(weight) AS total, count(*) AS n_query, list(token) AS query FROM {p}_q GROUP BY query_id),
{p}_m AS (
  SELECT *, CASE WHEN n_exact > 0 THEN (ew + 0.7 * only_w + 0.25 * pw) / total WHEN n_stem > 0 THEN 0.7 * sw / total ELSE 0.5 * pw / total END AS match
  FROM {p}_sums JOIN {p}_tot USING (query_id) JOIN {entries} USING (entry_id)),
{p}_scored AS (SELECT * FROM (
  SELECT query_id, entry_id, round(match, 6) AS match, CAST(n_exact AS INT) AS n_exact, round(match
    * CASE WHEN (round(match, 9) >= 0.3 OR (round(match, 9) >= 0.15 AND n_exact > 0)) AND n_query >= 3
      THEN CASE WHEN len(list_intersect(query, {_toks('tags_text')})) > 0 THEN 2.0 ELSE 1.0 END * CASE WHEN lower(coalesce(kind, '')) IN ({kinds}) THEN 1.5 ELSE 1.0 END ELSE 1.0 END
    * (1 + 0.1 * priority) * exp(-{DEFAULT.decay_rate} * age_days)
    * CASE WHEN n_exact > 0 AND len(tokens) > 3 THEN least(greatest(3.0 * direct / sqrt(len(tokens)), 0.15), 1.0) ELSE 1.0 END, 6) AS score
  FROM {p}_m) WHERE score > 0),
{p}_top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INT) AS rank FROM {p}_scored)"""


def _counted(p: str, results: str, texts: str, entries: str) -> str:
    return f"""
{p} AS (
  SELECT r.*, CAST(len(list_intersect({_toks('t.text')}, {_toks("e.content || ' ' || e.tags_text")})) AS INT) AS exact_matches
  FROM {results} r JOIN {texts} t USING (query_id) JOIN {entries} e USING (entry_id))"""


_EVERY = "doc_id % 100 = 0"
_BASE = f"WITH {_CORPUS}, {_intents(_EVERY)}"
_TIER = f"CASE WHEN exact_matches < 2 THEN NULL WHEN score >= {DEFAULT.hot} THEN 'HOT' WHEN score >= {DEFAULT.warm} THEN 'WARM' END"
_EXPANDED = f"""
extra AS (
  SELECT query_id, string_agg(alias, ' ' ORDER BY alias) AS extra FROM (
    SELECT DISTINCT query_id, alias FROM (SELECT query_id, unnest({_words('text')}) AS token FROM admitted) JOIN alias_pairs USING (token)) GROUP BY query_id),
wide AS (SELECT query_id, concat_ws(' ', text, extra) AS text FROM admitted LEFT JOIN extra USING (query_id))"""
_PIPED = "array_to_string(list_transform(coalesce(tags, []), lambda t: coalesce(t, '')), '|')"
_PATH = f"""{_BASE}, {_EXPANDED}, {_search('c', 'admitted', 'core')}, {_search('k', 'admitted', 'log')}, {_search('w', 'wide', 'log')},
w5 AS (SELECT query_id, entry_id, rank AS place FROM w_top WHERE rank <= 5),
{_search('r', 'admitted', 'log', None, only_pairs='w5')},
{_counted('cres', '(SELECT * FROM c_top WHERE rank <= 5)', 'admitted', 'core')},
seen AS (SELECT DISTINCT query_id, lower(substring(content, 1, 80)) AS key FROM cres JOIN core USING (entry_id)),
branches AS (
  SELECT query_id, entry_id, score, 0 AS branch, rank AS place FROM k_top WHERE rank <= 5
  UNION ALL SELECT query_id, entry_id, score, 1, place FROM r_scored JOIN w5 USING (query_id, entry_id)),
once AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, substring(content, 1, 80) ORDER BY score DESC, branch, place) AS n
  FROM branches b JOIN log USING (entry_id) WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.query_id = b.query_id AND s.key = lower(substring(content, 1, 80)))),
fused0 AS (SELECT query_id, entry_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, branch, place) AS INT) AS rank FROM once WHERE n = 1),
{_counted('fused', '(SELECT * FROM fused0 WHERE rank <= 5)', 'admitted', 'log')},
tiers AS (SELECT * FROM (SELECT *, {_TIER} AS tier FROM fused) WHERE tier IS NOT NULL),
ctiers AS (SELECT * FROM (SELECT *, {_TIER} AS tier FROM cres) JOIN core USING (entry_id) WHERE tier IS NOT NULL)"""
_WHOLE_PATH = _PATH.replace(_intents(_EVERY), _intents("true"))
_NOTHING_USED = "used AS (SELECT CAST(NULL AS BIGINT) AS query_id, CAST(NULL AS BIGINT) AS used WHERE false)"
_CORE_BLOCK = f"""
chot AS (
  SELECT query_id, 'HOT' AS tier, rank AS place, '**[' || coalesce(section, '') || ']** ' || CASE WHEN length(content) > 300 THEN substring(content, 1, 297) || '...' ELSE content END AS entry
  FROM ctiers WHERE tier = 'HOT'),
chot2 AS (SELECT c.*, coalesce(used, 0) + sum(length(entry)) OVER (PARTITION BY query_id ORDER BY place) AS upto FROM chot c LEFT JOIN used USING (query_id) WHERE {DEFAULT.budget} - coalesce(used, 0) > 200 QUALIFY upto <= {DEFAULT.budget}),
cwarm AS (
  SELECT query_id, 'WARM' AS tier, rank AS place, '- [' || coalesce(section, '') || '] ' || {_preview('content')} AS entry FROM ctiers WHERE tier = 'WARM'),
cwarm2 AS (
  SELECT w.*, coalesce(h.spent, used, 0) + sum(length(entry)) OVER (PARTITION BY query_id ORDER BY place) AS upto
  FROM cwarm w LEFT JOIN (SELECT query_id, max(upto) AS spent FROM chot2 GROUP BY query_id) h USING (query_id) LEFT JOIN used USING (query_id) WHERE {DEFAULT.budget} - coalesce(used, 0) > 200 QUALIFY upto <= {DEFAULT.budget})"""

_NEAR = f"len(c.words) > 0 AND len(words) > 0 AND len(list_intersect(c.words, words)) >= {DEFAULT.cluster} * len(list_distinct(list_concat(c.words, words)))"
_CLUSTERS = f"""
hot AS (SELECT query_id, rank, entry_id, kind, content, {_toks('content')} AS words, coalesce(kind IN ({_quoted(fixed.PROTECTED_TYPES)}), false) AS kept FROM tiers JOIN log USING (entry_id) WHERE tier = 'HOT'),
mergeable AS (SELECT query_id, rank, words, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM hot WHERE NOT kept),
folded(query_id, i, clusters) AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(head INT, words VARCHAR[], n INT)[]) FROM mergeable
  UNION ALL
  SELECT query_id, i, CASE WHEN hit IS NULL THEN list_append(clusters, {{'head': rank, 'words': words, 'n': 1}})
    ELSE list_transform(clusters, lambda c, k: CASE WHEN k = hit THEN {{'head': c.head, 'words': list_distinct(list_concat(c.words, words)), 'n': c.n + 1}} ELSE c END) END
  FROM (
    SELECT f.query_id, m.i, f.clusters, m.rank, m.words, list_filter(list_transform(f.clusters, lambda c, k: CASE WHEN {_NEAR} THEN k END), lambda x: x IS NOT NULL)[1] AS hit
    FROM folded f JOIN mergeable m ON m.query_id = f.query_id AND m.i = f.i + 1)),
heads AS (SELECT query_id, c.head AS rank, c.n AS n FROM (SELECT query_id, unnest(arg_max(clusters, i)) AS c FROM folded GROUP BY query_id)),
merged AS (
  SELECT query_id, rank, 0 AS late, 0 AS related FROM hot WHERE kept UNION ALL SELECT query_id, rank, 1, n - 1 FROM heads),
clusters AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS INT) AS place, entry_id, kind, CASE WHEN related > 0 THEN content || ' (+' || related || ' related)' ELSE content END AS content, CAST(related AS INT) AS related
  FROM merged JOIN hot USING (query_id, rank))"""
_BLOCK = f"""
budgets AS (
  SELECT query_id, {DEFAULT.budget} - coalesce(spent, used, 0) AS budget FROM admitted LEFT JOIN used USING (query_id)
  LEFT JOIN (SELECT query_id, max(upto) AS spent FROM (SELECT * FROM chot2 UNION ALL SELECT * FROM cwarm2) GROUP BY query_id) USING (query_id) WHERE {DEFAULT.budget} - coalesce(spent, used, 0) > 200),
bhot AS (
  SELECT *, 60 + sum(length(entry)) OVER (PARTITION BY query_id ORDER BY place) AS upto
  FROM (SELECT query_id, place, budget, '### [' || coalesce(kind, '') || ']' || chr(10) || content || chr(10) AS entry FROM clusters JOIN budgets USING (query_id)) QUALIFY upto <= budget),
bspent AS (SELECT query_id, coalesce(max(upto), 60) AS spent FROM (SELECT DISTINCT query_id FROM clusters) LEFT JOIN bhot USING (query_id) GROUP BY query_id),
bwarm AS (
  SELECT query_id, place, entry, used + 40 + sum(length(entry)) OVER (PARTITION BY query_id ORDER BY place) AS upto
  FROM (
    SELECT t.query_id, t.rank AS place, budget, coalesce(spent, 0) AS used, '- [' || coalesce(kind, '') || '] ' || {_preview('content')} AS entry
    FROM tiers t JOIN log USING (entry_id) JOIN budgets USING (query_id) LEFT JOIN bspent USING (query_id) WHERE tier = 'WARM' AND coalesce(spent, 0) < budget) QUALIFY upto <= budget)"""

_DECISION = f"""
placed AS (
  SELECT line_num, content, length(content) AS length, octet_length(encode(content)) + 1 AS bytes, {_words('content')} AS words, lower(substring(content, 1, 80)) AS start,
    row_number() OVER (ORDER BY line_num) AS pos FROM (SELECT line_num, coalesce(content, '') AS content FROM memory_log WHERE line_num IS NOT NULL)),
met AS (
  SELECT a.line_num, a.pos, a.length, b.pos AS old_pos, b.line_num AS old_line, b.length AS old_length, a.start = b.start AS same_start,
    len(list_intersect(a.words, b.words)) AS common, len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)) AS total,
    sum(b.bytes) OVER (PARTITION BY a.pos ORDER BY b.pos DESC) AS upto
  FROM placed a JOIN placed b ON b.pos BETWEEN a.pos - {DEFAULT.tail_rows + 1} AND a.pos - 1 WHERE a.length > 0),
best AS (
  SELECT line_num, bool_or(pos - old_pos <= {DEFAULT.tail_rows} AND (same_start OR (total > 0 AND common > {DEFAULT.duplicate} * total))) AS same,
    max(CASE WHEN total > 0 AND common > 0 AND common >= {DEFAULT.supersede_from} * total AND common <= {DEFAULT.duplicate} * total AND length >= old_length THEN old_line END) AS target
  FROM met WHERE upto < {DEFAULT.tail_bytes} GROUP BY line_num),
hashes AS (
  SELECT line_num, min(line_num) OVER (PARTITION BY {_HASH}) AS first_line FROM memory_log WHERE content IS NOT NULL AND line_num IS NOT NULL),
decided AS (
  SELECT p.line_num, CASE WHEN p.length = 0 THEN 'APPEND' WHEN h.line_num IS NOT NULL OR same THEN 'SKIP' WHEN target IS NOT NULL THEN 'SUPERSEDE' ELSE 'APPEND' END AS decision, target
  FROM placed p LEFT JOIN best USING (line_num) LEFT JOIN (SELECT line_num FROM hashes WHERE line_num > first_line) h USING (line_num)),
decisions AS (SELECT line_num, decision, CASE WHEN decision = 'SUPERSEDE' THEN target END AS target FROM decided)"""


def _summaries(source: str = "memory_log") -> str:
    """For every asking session: the newest checkpoint of another one, else tags or snippets of the latest other one's last block."""
    return f"""
asking AS (SELECT row_number() OVER () AS a, session_id, substring(coalesce(session_id, ''), 1, 8) AS own FROM (SELECT DISTINCT session_id FROM documents)),
said AS (
  SELECT a, line_num, substring(r.session_id, 1, 8) AS sid, type, coalesce(content, '') AS content, tags
  FROM {source} r JOIN asking ON substring(r.session_id, 1, 8) <> own WHERE r.session_id <> 'unknown' AND line_num IS NOT NULL),
points AS (SELECT a, arg_max(content, line_num) AS content FROM said WHERE type = 'SESSION_CHECKPOINT' GROUP BY a),
newest AS (SELECT a, arg_max(sid, line_num) AS sid FROM said GROUP BY a),
older AS (SELECT s.a, max(line_num) AS upto FROM said s JOIN newest n ON n.a = s.a AND n.sid <> s.sid GROUP BY s.a),
block AS (SELECT s.* FROM said s JOIN newest n ON n.a = s.a AND n.sid = s.sid LEFT JOIN older o ON o.a = s.a WHERE upto IS NULL OR line_num > upto),
btags AS (
  SELECT a, tag, max((line_num, -posn)) AS seen FROM (SELECT a, line_num, unnest(tags) AS tag, generate_subscripts(tags, 1) AS posn FROM block)
  WHERE tag IS NOT NULL AND lower(tag) NOT IN ({_quoted(fixed.SUMMARY_SKIPPED_TAGS)}) GROUP BY ALL),
btop AS (SELECT a, string_agg(tag, ', ' ORDER BY seen DESC) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY seen DESC) AS n FROM btags) WHERE n <= 8 GROUP BY a),
bparts AS (SELECT a, string_agg(substring(content, 1, 40), ' | ' ORDER BY line_num DESC) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY line_num DESC) AS n FROM block) WHERE n <= 3 GROUP BY a),
summaries AS (
  SELECT session_id, substring(coalesce(points.content, '{fixed.TOPICS_HEAD}' || tags, '{fixed.SNIPPETS_HEAD}' || parts, ''), 1, 250) AS summary
  FROM asking LEFT JOIN points USING (a) LEFT JOIN btop USING (a) LEFT JOIN bparts USING (a))"""


_TAIL_4096 = "tail4096 AS (SELECT * FROM (SELECT *, sum(octet_length(encode(coalesce(content, ''))) + 1) OVER (ORDER BY line_num DESC) AS upto FROM memory_log WHERE line_num IS NOT NULL) WHERE upto < 4096)"


def _soundex() -> str:
    digits = f"translate(regexp_replace(upper(replace(token, 'ß', 'ss')), '[0-9]', '', 'g'), '{fixed.SOUNDEX_LETTERS}', '{fixed.SOUNDEX_DIGITS}')"
    digits = f"regexp_replace({digits}, '[^1-6]', '', 'g')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    first = "substring(upper(replace(token, 'ß', 'ss')), 1, 1)"
    return f"CASE WHEN NOT regexp_matches({first}, '^\\p{{L}}') THEN '' ELSE rpad({first} || substring(CASE WHEN contains('{fixed.SOUNDEX_LETTERS}', {first}) THEN substring({digits}, 2) ELSE {digits} END, 1, 3), 4, '0') END"


def _joined(words: str) -> str:
    return f"array_to_string(list_sort(list_distinct({words})), ' ')"


def _codes(words: str) -> str:
    return f"list_filter(list_transform({words}, lambda token: {_soundex()}), lambda c: c <> '')"


def _corrections() -> str:
    options = []
    for pattern, group, kind in fixed.CORRECTION_PATTERNS:
        got = f"regexp_replace({_strip(f'regexp_extract(p, {_lit(_portable(pattern))}, {group}, {_lit("is")})')}, '{SPACE}+', ' ', 'g')"
        options.append((got, kind))
    case = "CASE " + " ".join(f"WHEN length(c{i}) >= 10 THEN {{{i}}}" for i in range(len(options))) + " END"
    columns = ", ".join(f"{got} AS c{i}" for i, (got, _) in enumerate(options))
    content = case.format(*[f"c{i}" for i in range(len(options))])
    kind = case.format(*[_lit(k) for _, k in options])

    def at(ch: str) -> str:
        p = f"(CASE WHEN instr(substring(c, 41), '{ch}') > 0 THEN instr(substring(c, 41), '{ch}') + 40 ELSE 0 END)"
        return f"CASE WHEN {p} > 41 AND {p} < 201 THEN {p} END"

    return f"""
cp AS (SELECT line_num AS query_id, content AS prompt, {_strip('content')} AS p FROM memory_log WHERE content IS NOT NULL AND line_num IS NOT NULL),
cc AS (SELECT query_id, prompt, {columns} FROM cp),
ck AS (SELECT query_id, prompt, {kind} AS type, {content} AS c FROM cc),
ce AS (SELECT *, coalesce({at('.')}, {at('!')}, {at('?')}) AS e FROM ck WHERE c IS NOT NULL),
corr AS (SELECT query_id, type, substring(CASE WHEN length(c) > 120 AND e IS NOT NULL THEN substring(c, 1, e) ELSE c END, 1, 300) AS content, substring(prompt, 1, 500) AS full_prompt FROM ce)"""


def _smart(rows: str) -> str:
    return f"""
plain AS (SELECT query_id, regexp_replace(regexp_replace(lower(content || ' ' || full_prompt), '[^\\p{{L}}\\p{{N}}\\x00-\\x7f]', ' ', 'g'), '[^\\x00-\\x7f]', 'X', 'g') AS t FROM {rows}),
tagw AS (SELECT query_id, unnest(m) AS tag, generate_subscripts(m, 1) AS posn FROM (SELECT query_id, regexp_extract_all(t, '\\b[a-z][a-z0-9_-]{{2,}}\\b') AS m FROM plain)),
tagf AS (SELECT query_id, tag, min(posn) AS posn FROM tagw WHERE tag NOT IN ({_quoted(fixed.TAG_STOP_WORDS)}) GROUP BY ALL),
tagk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY posn) AS n FROM tagf),
smart AS (SELECT query_id, string_agg(tag, ',' ORDER BY n) AS tags FROM tagk WHERE n <= 8 GROUP BY query_id)"""


def _decisions(where: str = "true") -> str:
    parts = []
    for n, (pattern, kind) in enumerate(fixed.DECISION_PATTERNS):
        parts.append(f"SELECT doc_id, {n} AS pattern, generate_subscripts(m, 1) AS posn, '{kind}' AS type, unnest(m) AS raw FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_lit(_portable(pattern))}, 1, 'i') AS m FROM documents WHERE doc_id IS NOT NULL AND {where})")
    verb = rf"regexp_matches(content, '[\p{{L}}\p{{N}}_](?:{fixed.VERB_LIKE})(?:[^\p{{L}}\p{{N}}_]|$)', 'i')"
    return f"""
raw AS ({' UNION ALL '.join(parts)}),
cut AS (SELECT doc_id, pattern, posn, type, substring(regexp_replace({_strip('raw')}, '[\\n\\r]+', ' ', 'g'), 1, 300) AS content FROM raw),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(substring(content, 1, 50)) ORDER BY pattern, posn) AS n FROM cut WHERE length(content) >= 50 AND {verb}),
matches AS (SELECT *, row_number() OVER () AS query_id FROM good WHERE n = 1)"""


def _ranked(rows: str, most: int = 10) -> str:
    return f"SELECT * FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pattern, posn) AS INT) AS place, type, content FROM {rows}) WHERE place <= {most}"


_K = "coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)"
_COMMAND = f"CASE WHEN {_K} % 3 = 0 THEN 'pytest suite_' || {_K} WHEN {_K} % 5 = 0 THEN 'pip install pkg_' || {_K} ELSE 'make target_' || {_K} END"
_ACTS = f"""
acts AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, ts, {_K} AS k, {_COMMAND} AS cmd,
    CASE event_type WHEN 'click' THEN 'CHANGED' WHEN 'error' THEN 'TRIED-FAILED' ELSE 'INFRA' END AS category,
    CASE event_type WHEN 'click' THEN 'Edited mod_' || {_K} || '.py' WHEN 'error' THEN 'Command failed: ' || {_COMMAND} || ' -> Error: exit of step ' || {_K} || ' failed' ELSE 'Ran: ' || {_COMMAND} END AS description
  FROM events WHERE event_type IN ('click', 'error', 'purchase') AND event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL),
placed_acts AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS INT) AS place FROM acts)"""
_RETRY = """
flags AS (
  SELECT a.session_id, a.event_id, a.place,
    count(*) FILTER (b.category = 'TRIED-FAILED') >= 2 AND max(b.place) FILTER (b.category <> 'TRIED-FAILED') > max(b.place) FILTER (b.category = 'TRIED-FAILED') AS retry
  FROM placed_acts a JOIN placed_acts b ON b.session_id = a.session_id AND b.place BETWEEN a.place - 7 AND a.place WHERE a.place >= 3 GROUP BY ALL)"""


_HOUR = "strftime(ts, '%Y-%m-%d-%H')"


def _resolved(session: str | None) -> str:
    """Failures with the first success within the horizon, of the same session (an expression), or of anyone."""
    same = f"AND f.{session} = e.{session}" if session else ""
    return f"""
WITH {_ACTS},
known AS (SELECT *, {_HOUR} AS hour FROM acts),
fixes AS (
  SELECT e.event_id, f.event_id AS fixed_by, e.k, f.description, row_number() OVER (PARTITION BY e.event_id ORDER BY f.ts, f.event_id) AS n
  FROM known e JOIN known f ON f.ts BETWEEN e.ts AND e.ts + INTERVAL {FIX} SECOND AND (f.ts, f.event_id) > (e.ts, e.event_id) {same}
  WHERE e.category = 'TRIED-FAILED' AND f.category <> 'TRIED-FAILED' AND length(f.description) >= 15)
SELECT event_id, fixed_by, 'Resolved ''Error: exit of step ' || k || ' failed'' by: ' || description AS content FROM fixes WHERE n = 1"""


_TESTS = f"""
edits AS (SELECT {_HOUR} AS hour, ts, event_id, 'mod_' || k || '.py' AS file, 'mod_' || k || '.py: limit = ' || k || ' -> limit = ' || (k + 1) AS text FROM acts WHERE category = 'CHANGED'),
runs AS (SELECT event_id, {_HOUR} AS hour, ts, category, k FROM acts WHERE category <> 'CHANGED' AND contains(cmd, 'pytest')),
met AS (
  SELECT r.event_id, r.category, r.k, e.file, e.text, row_number() OVER (PARTITION BY r.event_id ORDER BY e.ts, e.event_id) AS n
  FROM runs r JOIN edits e ON e.hour = r.hour AND e.ts <= r.ts AND r.ts - e.ts < INTERVAL {FIX} SECOND
  WHERE NOT EXISTS (SELECT 1 FROM runs p WHERE p.category = 'INFRA' AND p.hour = r.hour AND (p.ts, p.event_id) < (r.ts, r.event_id) AND (p.ts, p.event_id) >= (e.ts, e.event_id))),
results AS (
  SELECT event_id, k, CASE category WHEN 'INFRA' THEN 'pass' ELSE 'fail' END AS result, string_agg(DISTINCT file, ', ' ORDER BY file) AS files,
    string_agg(text, '; ' ORDER BY n) FILTER (n <= 5) AS changes, CAST(count(*) AS INT) AS n_edits,
    CASE category WHEN 'INFRA' THEN k || ' passed' ELSE 'collecting' || chr(10) || 'Error: exit of step ' || k || ' failed' END AS output FROM met GROUP BY event_id, category, k)"""


def oracle_sql() -> dict[str, str]:
    pick = "query_id, entry_id, score, rank"
    return {
        "idf_stats": f"WITH {_CORPUS} SELECT token, df, round(weight, 6) AS weight FROM weights",
        "token_postings": f"WITH {_CORPUS} SELECT entry_id, unnest(tokens) AS token FROM log",
        "vocab_stems": f"WITH {_CORPUS} SELECT token, {_stem('token')} AS stem FROM (SELECT DISTINCT unnest(tokens) AS token FROM log0)",
        "soundex_codes": f"WITH {_CORPUS} SELECT token, {_soundex()} AS code FROM (SELECT DISTINCT unnest(tokens) AS token FROM log0)",
        "quality_gate": f"SELECT line_num, {_SURFACING} AS surfacing, {_STORING} AS storing FROM memory_log",
        "content_hashes": f"SELECT line_num, {_HASH} AS hash FROM memory_log WHERE content IS NOT NULL",
        "decay_curve": f"SELECT line_num, CAST(round({_AGE} * 86400) AS BIGINT) AS age_seconds, round(exp(-{DEFAULT.decay_rate} * {_AGE}), 6) AS decay FROM memory_log",
        "query_token_topk": f"{_BASE}, {_search('k', 'admitted', 'log')} SELECT query_id, token, round(weight, 6) AS weight FROM k_q",
        "partial_matches": f"{_BASE}, {_search('k', 'admitted', 'log')} SELECT DISTINCT token, other FROM k_pairs",
        "search_prefilter_candidates": f"{_BASE}, {_search('k', 'admitted', 'log')} SELECT DISTINCT query_id, entry_id FROM k_ev WHERE part <> 'p'",
        "search_exact_topk": f"{_BASE}, {_search('k', 'admitted', 'log', only_exact=True)} SELECT {pick} FROM k_top WHERE rank <= 5",
        "search_log_topk": f"{_BASE}, {_search('k', 'admitted', 'log')} SELECT {pick}, match, n_exact FROM k_top WHERE rank <= 5",
        "search_cached_topk": f"""{_BASE}, {_search('k', 'admitted', 'log')},
shared AS (SELECT DISTINCT query_id, entry_id FROM k_ev WHERE part <> 'p')
SELECT {pick}, match, n_exact FROM (SELECT query_id, entry_id, score, match, n_exact, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INT) AS rank FROM k_scored SEMI JOIN shared USING (query_id, entry_id)) WHERE rank <= 5""",
        "search_core_topk": f"{_BASE}, {_search('k', 'admitted', 'core')} SELECT {pick} FROM k_top WHERE rank <= 5",
        "two_pass_rescore": f"{_BASE}, {_search('k', 'admitted', 'log')}, k20 AS (SELECT query_id, entry_id FROM k_top WHERE rank <= 20), {_search('r', 'admitted', 'log', None, only_pairs='k20')} SELECT query_id, entry_id, score FROM r_scored",
        "expanded_recall": f"{_BASE}, {_EXPANDED}, {_search('k', 'wide', 'log')} SELECT {pick} FROM k_top WHERE rank <= 5",
        "exact_match_counts": f"{_BASE}, {_search('k', 'admitted', 'log')}, {_counted('r', '(SELECT * FROM k_top WHERE rank <= 5)', 'admitted', 'log')} SELECT query_id, entry_id, exact_matches FROM r",
        "fused_merge_topk": f"{_PATH} SELECT {pick}, exact_matches FROM fused",
        "tiered_results": f"{_PATH} SELECT query_id, entry_id, tier, rank FROM tiers",
        "core_context": f"{_PATH}, {_NOTHING_USED}, {_CORE_BLOCK} SELECT query_id, tier, place, entry, CAST(upto AS BIGINT) AS upto FROM chot2 UNION ALL SELECT query_id, tier, place, entry, CAST(upto AS BIGINT) FROM cwarm2",
        "cluster_merge": f"{_PATH.replace('WITH', 'WITH RECURSIVE', 1)}, {_CLUSTERS} SELECT query_id, place, entry_id, related, content FROM clusters",
        "budgeted_context": f"{_PATH.replace('WITH', 'WITH RECURSIVE', 1)}, {_CLUSTERS}, {_NOTHING_USED}, {_CORE_BLOCK}, {_BLOCK} SELECT query_id, 'HOT' AS tier, place, entry, CAST(upto AS BIGINT) AS upto FROM bhot UNION ALL SELECT query_id, 'WARM', place, entry, CAST(upto AS BIGINT) FROM bwarm",
        "ack_markers": f"""{_WHOLE_PATH.replace('WITH', 'WITH RECURSIVE', 1)}, {_CLUSTERS}
SELECT query_id, a.session_id, count(*) AS count, string_agg('- [' || coalesce(kind, '') || '] ' || substring(string_split(content, chr(10))[1], 1, 100), chr(10) ORDER BY place) AS summary, a.text AS intent
FROM clusters JOIN admitted a USING (query_id) GROUP BY query_id, a.session_id, a.text""",
        "ack_current": f"""{_PATH.replace('WITH', 'WITH RECURSIVE', 1)}, {_CLUSTERS},
marks AS (SELECT query_id, a.session_id, count(*) AS count, a.text AS intent FROM clusters JOIN admitted a USING (query_id) GROUP BY query_id, a.session_id, a.text)
SELECT session_id, query_id, count, intent FROM marks WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY query_id DESC) = 1""",
        "gate_first_block": f"""
WITH calls AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, ts, event_type FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
last AS (
  SELECT c.session_id, c.event_id, c.ts, max(m.ts) AS posn FROM calls c JOIN calls m ON m.session_id = c.session_id AND m.event_type = 'error' AND m.ts <= c.ts
  WHERE c.event_type <> 'error' GROUP BY ALL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY session_id, posn ORDER BY ts, event_id) AS n FROM last WHERE ts - posn <= INTERVAL {GATE} SECOND)
SELECT session_id, event_id FROM firsts WHERE n = 1""",
        "prompt_filter": f"WITH {_intents('true')} SELECT query_id FROM admitted",
        "intent_extraction": f"WITH {_intents('true')} SELECT doc_id, intent FROM intents",
        "dedup_exact_hash": f"SELECT line_num, first_line FROM (SELECT line_num, min(line_num) OVER (PARTITION BY {_HASH}) AS first_line FROM memory_log WHERE content IS NOT NULL AND line_num IS NOT NULL) WHERE line_num > first_line",
        "dedup_decision": f"WITH {_DECISION} SELECT * FROM decisions",
        "dedup_summary": f"WITH {_DECISION} SELECT decision, count(*) AS n FROM decisions GROUP BY decision",
        "superseded_log": f"""
WITH {_DECISION},
versions AS (SELECT coalesce(target, d.line_num) AS line_num, content, d.line_num AS version FROM decisions d JOIN memory_log USING (line_num) WHERE decision <> 'SKIP')
SELECT line_num, arg_max(content, version) FILTER (content IS NOT NULL) AS content, max(version) AS version FROM versions GROUP BY line_num""",
        "near_dup_pairs": f"""
WITH sets AS (
  SELECT words, min(line_num) AS id, len(words) AS n FROM (SELECT line_num, list_sort({_words('content')}) AS words FROM memory_log WHERE content IS NOT NULL AND line_num IS NOT NULL) WHERE len(words) > 0 GROUP BY words),
met AS (SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS both_n, len(list_intersect(a.words, b.words)) AS common FROM sets a JOIN sets b ON a.id < b.id AND 2 * a.n > b.n AND 2 * b.n > a.n)
SELECT id_a, id_b, round(common / (both_n - common), 6) AS similarity FROM met WHERE 2 * common > both_n - common""",
        "near_dup_members": f"""
WITH sets AS (SELECT line_num, list_sort({_words('content')}) AS words FROM memory_log WHERE content IS NOT NULL AND line_num IS NOT NULL)
SELECT line_num, min(line_num) OVER (PARTITION BY words) AS id, count(*) OVER (PARTITION BY words) AS members FROM sets WHERE len(words) > 0""",
        "dup_by_search": f"""
WITH {_CORPUS}, ask AS (SELECT line_num AS query_id, substring(content, 1, 80) AS text FROM memory_log WHERE line_num % 100 = 0 AND content IS NOT NULL), {_search('k', 'ask', 'log')}
SELECT query_id, entry_id, score FROM k_top WHERE rank = 1 AND score > {DEFAULT.same}""",
        "repetition_check": f"""
WITH {_CORPUS}, ask AS (SELECT line_num AS query_id, content AS text FROM memory_log WHERE line_num % 100 = 0 AND content IS NOT NULL), {_search('k', 'ask', 'log')},
best AS (SELECT query_id, max(score) AS best FROM k_top JOIN log USING (entry_id) WHERE rank <= 3 AND kind IN ({_quoted(fixed.CORRECTION_TYPES)}) GROUP BY query_id)
SELECT query_id, coalesce(best, 0.0) AS best FROM ask LEFT JOIN best USING (query_id)""",
        "store_stats": "SELECT count(*) AS log_entries, arg_max(logged_at, line_num) FILTER (coalesce(logged_at, '') <> '') AS last_entry_date, (SELECT CAST(count(*) AS INT) FROM aliases) AS memory_lines FROM memory_log",
        "tail_scan": f"SELECT line_num FROM (SELECT line_num, sum(octet_length(encode(coalesce(content, ''))) + 1) OVER (ORDER BY line_num DESC) AS upto FROM memory_log) WHERE upto < {DEFAULT.tail_bytes}",
        "jsonl_entries": """
WITH ok AS (SELECT line_num, CAST(raw_json AS JSON) AS j FROM entry_cache WHERE json_valid(raw_json) AND starts_with(trim(raw_json), '{'))
SELECT line_num, j ->> 'type' AS type, j ->> 'content' AS content, array_to_string(list_transform(coalesce(CAST(j -> 'tags' AS VARCHAR[]), []), lambda t: coalesce(t, '')), '|') AS tags, coalesce(j ->> 'session_id', 'unknown') AS session_id FROM ok""",
        **dict.fromkeys(["entry_cache_build", "entry_cache_synced", "entry_cache_dirty"], f"""
WITH {_CORPUS},
t AS (SELECT entry_id AS line_num, tokens, {_toks('tags_text')} AS tags, lower(coalesce(kind, '')) AS entry_type, {_HASH} AS content_hash FROM log0)
SELECT line_num, {_joined('tokens')} AS tokens, {_joined(f"list_transform(tokens, lambda token: {_stem('token')})")} AS stems,
  {_joined(_codes('tokens'))} AS soundex_codes, {_joined('tags')} AS tag_tokens, {_joined(_codes('tags'))} AS tag_soundex, entry_type, content_hash FROM t"""),
        "idf_kept": f"""
WITH {_CORPUS},
old AS (SELECT entry_id, tokens FROM log0 WHERE entry_id < (SELECT min(entry_id) FROM (SELECT entry_id FROM log0 ORDER BY entry_id DESC LIMIT 40)) UNION ALL SELECT entry_id, tokens FROM core0),
old_weights AS (SELECT token, ln(1 + (SELECT count(*) FROM old) / count(*)) AS weight FROM (SELECT unnest(tokens) AS token FROM old) GROUP BY token)
SELECT 'kept' AS mode, token, round(weight, 6) AS weight FROM old_weights UNION ALL SELECT mode, token, round(weight, 6) FROM weights, (VALUES ('grown'), ('aged')) m(mode)""",
        "core_jsonl_scan": f"SELECT section, content, {_PIPED} AS tags, priority, type FROM core_tagged",
        "jsonl_append_scan": f"SELECT type, content, {_PIPED} AS tags, logged_at, coalesce(session_id, 'unknown') AS session_id, source FROM memory_log WHERE line_num IS NOT NULL",
        "alias_load": "SELECT alias_key, array_to_string(list_transform(expansions, lambda t: coalesce(t, '')), '|') AS expansions FROM aliases WHERE alias_key IS NOT NULL AND expansions IS NOT NULL",
        "transcript_json": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, unnest(range(len(string_split(text, chr(10))))) AS posn FROM documents WHERE kind = 'transcript' AND text IS NOT NULL)
SELECT doc_id, CAST(posn AS INT) AS pos, CASE WHEN starts_with(said, '[USER] ') THEN 'user' ELSE 'assistant' END AS role, CASE WHEN starts_with(said, '[USER] ') THEN substring(said, 8) ELSE said END AS text FROM l WHERE said NOT IN ('', '[USER] ')""",
        "completion_keys": "SELECT line_num, substring(md5(content), 1, 16) AS prompt_key, substring(md5(content), 1, 12) AS verdict_key FROM memory_log WHERE content IS NOT NULL",
        "completion_memo": """
WITH p AS (SELECT line_num AS id, content, substring(md5(content), 1, 16) AS key FROM memory_log WHERE line_num IS NOT NULL)
SELECT id, key, (SELECT min(upper(substring(replace(m.content, 'ß', 'SS'), 1, 20))) FROM p m WHERE m.key = p.key AND m.id % 2 = 0) AS response FROM p""",
        "cache_staleness": f"""
SELECT CASE WHEN content_hash IS NULL AND c.line_num IS NULL THEN 'missing' WHEN content_hash IS NULL THEN 'unhashed' WHEN content_hash = {_HASH} THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n
FROM memory_log m LEFT JOIN entry_cache c ON c.line_num = m.line_num GROUP BY 1""",
        "idf_staleness": f"""
WITH {_CORPUS}
SELECT token, round(w.weight, 6) AS weight, round(i.weight, 6) AS old_weight, coalesce(abs(w.weight - i.weight) > 0.01, true) AS stale FROM weights w FULL JOIN idf_weights i USING (token)""",
        "transcript_lines": f"""
WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {_strip('x')} <> '') AS l FROM documents WHERE kind = 'transcript' AND text IS NOT NULL),
u AS (SELECT doc_id, l[greatest(len(l) - 199, 1):] AS l FROM t)
SELECT doc_id, CAST(len(l) AS INT) AS n_lines, CAST(len(list_filter(l, lambda x: starts_with(x, '[USER] '))) AS INT) AS n_user, array_to_string(l, chr(10)) AS text FROM u""",
        "session_summary": f"WITH {_summaries()} SELECT * FROM summaries",
        "session_summary_tail": f"WITH {_TAIL_4096}, {_summaries('tail4096')} SELECT * FROM summaries",
        "assembled_context": f"""{_WHOLE_PATH.replace('WITH', 'WITH RECURSIVE', 1)}, {_summaries()},
used AS (SELECT query_id, length(summary) + 25 AS used FROM admitted JOIN summaries USING (session_id) WHERE summary <> ''),
{_CLUSTERS}, {_CORE_BLOCK}, {_BLOCK},
known AS (
  SELECT query_id, concat_ws(chr(10), hot, warm) AS known FROM (SELECT query_id, string_agg(entry, chr(10) || chr(10) ORDER BY place) AS hot FROM chot2 GROUP BY query_id)
  FULL JOIN (SELECT query_id, string_agg(entry, chr(10) ORDER BY place) AS warm FROM cwarm2 GROUP BY query_id) USING (query_id)),
learned AS (
  SELECT query_id, hot, warm FROM (SELECT query_id, string_agg(entry, chr(10) ORDER BY place) AS hot FROM bhot GROUP BY query_id)
  FULL JOIN (SELECT query_id, string_agg(entry, chr(10) ORDER BY place) AS warm FROM bwarm GROUP BY query_id) USING (query_id))
SELECT query_id, session_id, concat_ws(chr(10),
  CASE WHEN coalesce(summary, '') <> '' THEN '{fixed.LAST_TITLE}' || chr(10) || summary || chr(10) END,
  {_lit(fixed.CORE_TITLE)} || chr(10) || chr(10) || known || chr(10),
  {_lit(fixed.LOG_TITLE)} || chr(10) || hot,
  {_lit(fixed.WARM_TITLE)} || chr(10) || warm,
  chr(10) || {_lit(fixed.DIRECTIVE)}) AS context
FROM admitted LEFT JOIN summaries USING (session_id) LEFT JOIN known USING (query_id) LEFT JOIN learned USING (query_id)""",
        "session_topics": f"""
WITH r AS (SELECT session_id, line_num, content, tags FROM memory_log WHERE session_id IS NOT NULL AND session_id NOT IN ('', 'unknown') AND line_num IS NOT NULL),
t AS (SELECT session_id, tag, max((line_num, -posn)) AS seen FROM (SELECT session_id, line_num, unnest(tags) AS tag, generate_subscripts(tags, 1) AS posn FROM r) WHERE tag IS NOT NULL AND lower(tag) NOT IN ({_quoted(fixed.SUMMARY_SKIPPED_TAGS)}) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seen DESC, tag) AS n FROM t),
top AS (SELECT session_id, string_agg(tag, ', ' ORDER BY n) AS tags FROM k WHERE n <= 8 GROUP BY session_id),
three AS (SELECT session_id, substring(coalesce(content, ''), 1, 40) AS part, row_number() OVER (PARTITION BY session_id ORDER BY line_num DESC) AS n FROM r),
parts AS (SELECT session_id, string_agg(part, ' | ' ORDER BY n) AS parts FROM three WHERE n <= 3 GROUP BY session_id)
SELECT session_id, substring(CASE WHEN tags IS NOT NULL THEN 'Last session topics: ' || tags ELSE 'Last session: ' || parts END, 1, 250) AS summary FROM parts LEFT JOIN top USING (session_id)""",
        "session_checkpoints": f"""
WITH r AS (SELECT session_id, line_num, content, tags FROM memory_log WHERE session_id IS NOT NULL AND session_id <> '' AND line_num IS NOT NULL),
three AS (SELECT session_id, substring(coalesce(content, ''), 1, 100) AS part, row_number() OVER (PARTITION BY session_id ORDER BY line_num) AS n FROM r),
parts AS (SELECT session_id, string_agg(part, ' | ' ORDER BY n) AS parts FROM three WHERE n <= 3 GROUP BY session_id),
t AS (SELECT session_id, tag, min((line_num, posn)) AS seen FROM (SELECT session_id, line_num, unnest(tags) AS tag, generate_subscripts(tags, 1) AS posn FROM r) WHERE tag IS NOT NULL AND lower(tag) NOT IN ({_quoted(fixed.CHECKPOINT_SKIPPED_TAGS)}) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seen, tag) AS n FROM t),
five AS (SELECT session_id, string_agg(tag, ',' ORDER BY n) AS tags FROM k WHERE n <= 5 GROUP BY session_id)
SELECT session_id, substring('Session ' || substring(session_id, 1, 8) || ': ' || parts, 1, 500) AS content, concat_ws(',', 'session_checkpoint', tags) AS tags FROM parts LEFT JOIN five USING (session_id)""",
        "corrections_extracted": f"WITH {_corrections()} SELECT query_id, type, content FROM corr",
        "correction_gate": f"SELECT line_num AS query_id, {_any('lower(content)', fixed.CORRECTION_SIGNALS)} AS signals, length(content) >= 50 AND {_any('lower(content)', fixed.WEAK_SIGNALS)} AS weak FROM memory_log WHERE content IS NOT NULL AND line_num IS NOT NULL",
        "smart_tags": f"WITH {_corrections()}, {_smart('corr')} SELECT query_id, coalesce(tags, '') AS tags FROM corr LEFT JOIN smart USING (query_id)",
        "correction_pipeline": f"""
WITH {_CORPUS}, {_corrections()},
able AS (
  SELECT c.* FROM corr c JOIN memory_log m ON m.line_num = c.query_id
  WHERE length(m.content) >= 20 AND {_any('lower(m.content)', fixed.CORRECTION_SIGNALS)}),
ask AS (SELECT query_id, content AS text FROM (SELECT * FROM able) WHERE {_STORING}),
{_search('k', 'ask', 'log')},
best AS (SELECT query_id, max(score) AS best FROM k_top JOIN log USING (entry_id) WHERE rank <= 3 AND kind IN ({_quoted(fixed.CORRECTION_TYPES)}) GROUP BY query_id),
{_smart('able')},
kept AS (SELECT query_id, coalesce(best, 0.0) AS best FROM ask LEFT JOIN best USING (query_id) WHERE coalesce(best, 0.0) <= {DEFAULT.same}),
last AS (
  SELECT * FROM (SELECT line_num, coalesce(content, '') AS content, row_number() OVER w AS k, sum(octet_length(encode(coalesce(content, ''))) + 1) OVER w AS upto FROM memory_log WHERE line_num IS NOT NULL WINDOW w AS (ORDER BY line_num DESC))
  WHERE k <= {DEFAULT.tail_rows + 1} AND upto < {DEFAULT.tail_bytes}),
near AS (
  SELECT query_id, k, line_num, length(a.content) >= length(l.content) AS longer, lower(substring(a.content, 1, 80)) = lower(substring(l.content, 1, 80)) AS same_start,
    len(list_intersect({_words('a.content')}, {_words('l.content')})) AS common, len({_words('a.content')}) + len({_words('l.content')}) - len(list_intersect({_words('a.content')}, {_words('l.content')})) AS total
  FROM able a, last l),
verdict AS (
  SELECT a.query_id, CASE WHEN substring(md5(lower(a.content)), 1, 16) IN (SELECT substring(md5(lower(content)), 1, 16) FROM memory_log WHERE content <> '') OR bool_or(k <= {DEFAULT.tail_rows} AND (same_start OR common > {DEFAULT.duplicate} * total)) THEN 'SKIP'
      WHEN bool_or(common > 0 AND common >= {DEFAULT.supersede_from} * total AND common <= {DEFAULT.duplicate} * total AND longer) THEN 'SUPERSEDE' ELSE 'APPEND' END AS decision,
    max(line_num) FILTER (common > 0 AND common >= {DEFAULT.supersede_from} * total AND common <= {DEFAULT.duplicate} * total AND longer) AS target
  FROM able a LEFT JOIN near USING (query_id) GROUP BY a.query_id, a.content)
SELECT query_id, CASE WHEN best > {DEFAULT.repeat} THEN 'REPEATED_CORRECTION' ELSE type END AS type, content,
  concat_ws(',', tags, 'user_correction', 'auto_detected', CASE WHEN best > {DEFAULT.repeat} THEN 'repeated' END) AS tags,
  decision, CASE WHEN decision = 'SUPERSEDE' THEN target END AS target
FROM able JOIN kept USING (query_id) JOIN verdict USING (query_id) LEFT JOIN smart USING (query_id)""",
        "validate_learnings": f"""
WITH ok AS (SELECT line_num AS id, CAST(raw_json AS JSON) AS j FROM entry_cache WHERE json_valid(raw_json) AND starts_with(trim(raw_json), '{{')),
p AS (SELECT id, {_strip("coalesce(j ->> 'content', '')")} AS content, {_strip("coalesce(j ->> 'type', '')")} AS type, coalesce(CAST(j -> 'tags' AS VARCHAR[]), []) AS tags FROM ok)
SELECT id, CASE WHEN type IN ({_quoted(fixed.VALID_TYPES)}) THEN type ELSE 'WORKING_SOLUTION' END AS type, substring(content, 1, 500) AS content,
  array_to_string(list_filter(list_transform(list_filter(tags, lambda t: t IS NOT NULL), lambda t: lower({_strip('t')})), lambda t: length(t) >= 2)[1:8], ',') AS tags
FROM p WHERE length(content) >= 20""",
        "decisions_extracted": f"WITH {_decisions()} {_ranked('matches')}",
        "decisions_new": f"""
WITH {_CORPUS}, {_decisions()}, ask AS (SELECT query_id, substring(content, 1, 80) AS text FROM matches), {_search('k', 'ask', 'log')},
fresh AS (SELECT * FROM matches WHERE query_id NOT IN (SELECT query_id FROM k_top WHERE rank = 1 AND score > {DEFAULT.same}))
{_ranked('fresh')}""",
        "plan_reasoning": f"""
WITH plans AS (SELECT doc_id, text, 'Chose item ' || doc_id || ' because ' || regexp_replace(substring(text, 1, 200), '[^a-zA-Z0-9 ]', 'x', 'g') || ' and so on' AS reason FROM documents WHERE kind = 'plan' AND text IS NOT NULL),
parts AS (SELECT doc_id, {_strip("string_split_regex(chr(10) || text || chr(10) || '## Steps', '\n#{2,3}\\s')[1]")} AS m FROM plans UNION ALL SELECT doc_id, m FROM (SELECT doc_id, {_strip("regexp_extract(reason, '(?i)Chose .+? because .{50,300}')")} AS m FROM plans))
SELECT doc_id, substring(m, 1, 500) AS content FROM parts WHERE length(m) > 50""",
        "incremental_tail": """
WITH p AS (
  SELECT d.doc_id, CASE WHEN o > 0 AND o < length(text) THEN substring(text, CAST(o AS INT) + 1) ELSE text END AS part
  FROM (SELECT *, n_chars // 2 AS o FROM documents) d WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, part FROM p WHERE length(part) >= 100""",
        "activities": f"WITH {_ACTS} SELECT event_id, session_id, category, description FROM acts",
        "activity_summary": f"""
WITH {_ACTS},
late AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place DESC) AS n FROM placed_acts)
SELECT session_id, string_agg('[' || category || '] ' || substring(description, 1, 60), chr(10) ORDER BY place) AS summary FROM late WHERE n <= 10 GROUP BY session_id""",
        "error_resolution": _resolved("session_id"),
        "error_resolution_any": _resolved(None),
        "error_resolution_hourly": _resolved("hour"),
        "test_results": f"WITH {_ACTS}, {_TESTS} SELECT event_id, result, files, changes, n_edits, output FROM results",
        "test_failures_new": f"""
WITH {_CORPUS}, {_ACTS}, {_TESTS},
failures AS (SELECT event_id AS query_id, 'Tests FAILED after editing: ' || files || '. Changes: ' || changes || '. Failure output: ' || output AS content FROM results WHERE result = 'fail'),
ask AS (SELECT query_id, substring(content, 1, 80) AS text FROM failures), {_search('k', 'ask', 'log')}
SELECT query_id AS event_id, content FROM failures WHERE query_id NOT IN (SELECT query_id FROM k_top WHERE rank = 1 AND score > {DEFAULT.same})""",
        "signal_retry_success": f"WITH {_ACTS}, {_RETRY} SELECT session_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS n FROM flags WHERE retry) WHERE n = 1",
        "signal_config_breakthrough": f"""
WITH {_ACTS}, {_RETRY},
config AS (
  SELECT DISTINCT a.session_id, a.event_id, a.place FROM placed_acts a
  JOIN placed_acts b ON b.session_id = a.session_id AND b.place BETWEEN a.place - 7 AND a.place AND b.category = 'TRIED-FAILED' AND {_any('b.cmd', fixed.CONFIG_WORDS)}
  JOIN placed_acts c ON c.session_id = a.session_id AND c.place > b.place AND c.place <= a.place AND c.category = 'INFRA' WHERE a.place >= 3),
hits AS (SELECT c.* FROM config c JOIN flags f USING (session_id, event_id) WHERE NOT coalesce(f.retry, false))
SELECT session_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS n FROM hits) WHERE n = 1""",
    }
