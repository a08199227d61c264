"""DuckDB statements for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_LETTER_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_TAG_SET = "list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda t: " + _LETTER_KEY.format("coalesce(t, '')") + "), lambda t: t <> '')))"
_FORMAT = f"""
keyed AS (
  SELECT line_num, {_LETTER_KEY.format('content')} AS k, {_TAG_SET} AS s
  FROM memory_log WHERE content IS NOT NULL AND line_num IS NOT NULL),
grouped AS (
  SELECT line_num, k, min(line_num) OVER (PARTITION BY k, s) AS first_line, count(*) OVER (PARTITION BY k, s) AS n
  FROM keyed WHERE length(k) >= 20)"""

_CONTENTS = r"""
texts AS (
  SELECT line_num AS id, content FROM memory_log UNION ALL SELECT core_id, content FROM core_tagged),
sets AS (
  SELECT id, list_sort(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'))) AS w
  FROM texts WHERE content IS NOT NULL AND id IS NOT NULL),
big AS (SELECT id, w, len(w) AS n FROM sets WHERE len(w) >= 12)"""

_TAGGED = f"""
tagged AS (
  SELECT line_num AS id, {_TAG_SET} AS s FROM memory_log UNION ALL SELECT core_id, {_TAG_SET} FROM core_tagged),
big AS (SELECT DISTINCT id, s, len(s) AS n FROM tagged WHERE len(s) >= 6 AND id IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
WITH {_TAGGED},
pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS common
  FROM big a JOIN big b ON a.id < b.id)
SELECT DISTINCT id_a, id_b FROM pairs WHERE common * 10 >= 6 * (total - common)""",
        "p2_linked": f"""
WITH {_TAGGED},
classes AS (SELECT s, min(id) AS class_id, count(*) AS class_size FROM big GROUP BY s),
pairs AS (
  SELECT a.class_id AS x, b.class_id AS y, len(a.s) + len(b.s) AS total, len(list_intersect(a.s, b.s)) AS common
  FROM classes a JOIN classes b ON a.class_id <> b.class_id),
degree AS (SELECT x, count(*) AS n FROM pairs WHERE common * 10 >= 6 * (total - common) GROUP BY x)
SELECT id, class_id, class_size, coalesce(degree.n, 0) AS n_links
FROM big JOIN classes USING (s) LEFT JOIN degree ON x = class_id""",
        "p4_found": f"""
WITH {_CONTENTS},
pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS total, len(list_intersect(a.w, b.w)) AS common
  FROM big a JOIN big b ON a.id < b.id AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8)
SELECT id_a, id_b FROM pairs WHERE common * 10 >= 8 * (total - common)""",
        "p5_found": f"WITH {_FORMAT} SELECT DISTINCT first_line, line_num AS copy_line FROM grouped WHERE line_num <> first_line",
        "p5_collapsed": f"""
WITH {_FORMAT}
SELECT m.line_num, coalesce(g.n, 1) AS n_copies
FROM (SELECT DISTINCT line_num FROM memory_log WHERE line_num IS NOT NULL) m LEFT JOIN grouped g USING (line_num)
WHERE g.line_num IS NULL OR g.line_num = g.first_line""",
    }
