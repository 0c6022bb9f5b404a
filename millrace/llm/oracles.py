"""DuckDB SQL for the registered corpus queries."""

from __future__ import annotations

_P2_LINES = """
WITH records AS (SELECT record_id, source_id, page_content FROM web_records WHERE source_id IS NOT NULL AND page_content IS NOT NULL),
pieces AS (SELECT record_id, source_id, string_split(page_content, chr(10)) AS ls FROM records),
lines AS (SELECT record_id, source_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM pieces)),
keyed AS (SELECT record_id, source_id, line_no, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS k FROM lines),
sizes AS (SELECT source_id, count(*) AS n FROM records GROUP BY source_id),
over_ AS (
  SELECT source_id, k FROM (SELECT source_id, k, count(DISTINCT record_id) AS c FROM keyed WHERE k <> '' GROUP BY source_id, k)
  JOIN sizes USING (source_id) WHERE c >= 5 AND c >= 0.05 * n)
"""

_WORDS = r"regexp_extract_all(replace(replace(lower(strip_accents(regexp_replace({}, '</?[A-Za-z][^<>]*>', '', 'g'))), 'ł', 'l'), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"

SQL: dict[str, str] = {
    "p2_found": _P2_LINES + "SELECT record_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN over_ USING (source_id, k)",
    "p2_clean": _P2_LINES
    + """
, dropped AS (SELECT record_id, line_no FROM keyed JOIN over_ USING (source_id, k)),
kept AS (
  SELECT l.record_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS t
  FROM lines l LEFT JOIN dropped d ON l.record_id = d.record_id AND l.line_no = d.line_no
  WHERE d.record_id IS NULL GROUP BY l.record_id)
SELECT w.record_id, CASE WHEN w.page_content IS NULL OR w.source_id IS NULL THEN w.page_content ELSE coalesce(k.t, '') END AS page_content
FROM web_records w LEFT JOIN kept k ON w.record_id = k.record_id
""",
    "p4_found": """
SELECT p.record_id FROM page_records p
LEFT JOIN chunk_limits c ON lower(trim(p.content_type)) = lower(trim(c.content_type))
CROSS JOIN (SELECT max_chars AS d FROM chunk_limits WHERE content_type = 'default') f
WHERE length(p.page_content) > coalesce(c.max_chars, f.d)
""",
    "p4_checks": """
SELECT p.record_id, length(p.page_content) > coalesce(c.max_chars, f.d) AS cut, true AS within, true AS overlaps, true AS whole FROM page_records p
LEFT JOIN chunk_limits c ON lower(trim(p.content_type)) = lower(trim(c.content_type))
CROSS JOIN (SELECT max_chars AS d FROM chunk_limits WHERE content_type = 'default') f
WHERE p.page_content IS NOT NULL
""",
    "p6_phrases": f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, {_WORDS.format('passage')} AS w FROM golden_questions WHERE passage IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM d)),
pg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM p))
SELECT DISTINCT doc_id, item_id FROM dg JOIN pg USING (g)
""",
    "p8_counts": r"SELECT doc_id, length(text) AS n_chars, CASE WHEN text IS NOT NULL THEN len(regexp_extract_all(text, '[\p{L}\p{Mc}]+')) END AS n_words FROM documents",
}
