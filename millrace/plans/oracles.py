"""DuckDB SQL for the registered core queries. Array sources are exploded with ``unnest``; the rest is plain SQL."""

from __future__ import annotations

_TOK = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NETLOC = r"nullif(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)', 1), '')"
_HOST = r"regexp_replace(regexp_replace(lower(" + _NETLOC + r"), ':[0-9]*$', ''), '^www\.', '')"
_HASH = "sha256(coalesce({}, '') || {} || substr({}, 1, 100))"


def tok(column: str) -> str:
    return _TOK.format(column)


_SPARSE = f"""
q AS (SELECT DISTINCT item_id AS qid, unnest({tok("question")}) AS token FROM golden_questions),
d AS (SELECT doc_id, {tok("text")} AS ts FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, len, token, count(*) AS n FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS token FROM d) GROUP BY ALL),
tf AS (SELECT doc_id, token, n / len AS tf FROM p WHERE token IN (SELECT token FROM q)),
st AS (SELECT token, ln(((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY token),
sc AS (SELECT qid, doc_id AS id, sum(idf * tf) AS score FROM tf JOIN st USING (token) JOIN q USING (token) GROUP BY qid, doc_id),
sp AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 12)
"""
_DENSE = """
{name} AS (
  SELECT a.qid, b.vec_id AS id, list_cosine_similarity(a.v, CAST(b.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY a.qid ORDER BY round(list_cosine_similarity(a.v, CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank
  FROM ({queries}) a CROSS JOIN embeddings b QUALIFY rank <= 12)
"""
_FUSED = (
    "WITH "
    + _SPARSE
    + ","
    + _DENSE.format(name="de", queries="SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM golden_questions)")
    + """,
m AS (SELECT qid, id, min(d) AS dense_rank, min(s) AS sparse_rank FROM
  (SELECT qid, id, rank AS d, NULL AS s FROM de UNION ALL SELECT qid, id, NULL, rank FROM sp) GROUP BY qid, id),
fs AS (SELECT *, coalesce(CAST(0.6 AS DOUBLE) / (60 + dense_rank), 0) + coalesce(CAST(0.4 AS DOUBLE) / (60 + sparse_rank), 0) AS score FROM m),
fu AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) AS rank FROM fs QUALIFY rank <= 12)
"""
)
_HYDRATED = (
    _FUSED
    + f""",
hy AS (SELECT fu.*, d.text, d.source, d.title, d.published_at, g.question, list_distinct({tok("g.question")}) AS asked, {tok("d.text")} AS have
  FROM fu JOIN documents d ON d.doc_id = fu.id JOIN golden_questions g ON g.item_id = fu.qid),
gr AS (SELECT *, CASE WHEN len(asked) > 0 THEN CAST(len(list_filter(asked, lambda t: list_contains(coalesce(have, []), t))) AS DOUBLE) / len(asked) ELSE 0 END AS grade FROM hy)
"""
)
_HASHED = f"WITH h AS (SELECT record_id, batch_no, source, {_HASH.format('url', chr(39) + '0' + chr(39), 'page_content')} AS content_hash FROM web_records WHERE page_content IS NOT NULL)"

SQL: dict[str, str] = {
    "s1_tolerant_json": """
SELECT CAST(json_extract(line, '$.k') AS INTEGER) AS k, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 5) WHEN event_id % 11 = 0 THEN '[1, 2]' WHEN event_id % 13 = 0 THEN '  ' ELSE props END AS line FROM events)
WHERE CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END GROUP BY 1""",
    "s4_unseen_urls": "SELECT record_id, url FROM web_records WHERE batch_no > 0 AND url NOT IN (SELECT url FROM web_records WHERE batch_no = 0 AND url IS NOT NULL)",
    "s9_first_hit": "SELECT source, doc_id, content_type FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1",
    "s16_page_numbers": f"""
SELECT record_id, url, CAST(row_number() OVER (PARTITION BY url ORDER BY record_id) AS INTEGER) AS n,
  CASE WHEN date IS NULL THEN NULL WHEN length(replace(date, '-', '')) >= 8 THEN
    substr(replace(date, '-', ''), 1, 4) || '-' || substr(replace(date, '-', ''), 5, 2) || '-' || substr(replace(date, '-', ''), 7, 2) ELSE '' END AS iso
FROM page_records WHERE length({_STRIP.format('page_content')}) >= 50""",
    "s25_manifest_hosts": f"SELECT {_HOST.format('url')} AS host, count(*) AS records FROM web_records WHERE {_HOST.format('url')} IN (SELECT {_HOST.format('url')} FROM source_manifest WHERE {_HOST.format('url')} <> '') GROUP BY 1",
    "s27_url_lookup": """
WITH a AS (SELECT DISTINCT url AS asked FROM page_captures WHERE url IS NOT NULL),
t AS (SELECT DISTINCT asked, way, rtrim(asked, '/') || CASE WHEN way = 1 THEN '/' ELSE '' END AS url FROM a, (SELECT unnest([0, 1]) AS way)),
h AS (SELECT t.asked, t.way, p.record_id FROM page_captures p JOIN t ON p.url = t.url)
SELECT asked, record_id FROM h JOIN (SELECT asked, min(way) AS way FROM h GROUP BY asked) USING (asked, way)""",
    "s29_rows_as_text": """
SELECT o_orderkey, concat_ws(', ', 'o_orderkey: ' || o_orderkey, 'o_custkey: ' || o_custkey, 'o_orderstatus: ' || o_orderstatus, 'o_orderpriority: ' || o_orderpriority) AS page_content FROM orders""",
    "s30_sliding_windows": """
WITH w AS (SELECT event_id, time_bucket(INTERVAL '30 minutes', ts) AS b FROM events),
x AS (SELECT event_id, b AS s FROM w UNION ALL SELECT event_id, b - INTERVAL '30 minutes' FROM w)
SELECT s AS window_start, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM x GROUP BY s""",
    "x1_union_records": """
SELECT 'web_records' AS kind, source_id, count(*) AS n, CAST(0 AS BIGINT) AS pages FROM web_records GROUP BY source_id
UNION ALL SELECT 'page_captures', source_id, count(*), 0 FROM page_captures GROUP BY source_id
UNION ALL SELECT 'page_records', source_id, count(*), count(page) FROM page_records GROUP BY source_id""",
    "t3_date_year": "SELECT record_id, CASE WHEN length(date) >= 4 THEN CAST(try_cast(substr(date, 1, 4) AS INTEGER) AS VARCHAR) END AS y FROM web_records",
    "t5_year_in_url": r"SELECT record_id, CASE WHEN regexp_extract(url, '(20\d{2})', 1) <> '' THEN regexp_extract(url, '(20\d{2})', 1) || '-01-01' WHEN url IS NOT NULL THEN '' END AS since FROM web_records",
    "t6_hosts": f"SELECT record_id, {_NETLOC.format('url')} AS authority, {_HOST.format('url')} AS host FROM web_records",
    "t7_slugs": r"""
SELECT record_id, substr(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#]*)', 1)), '[^\p{L}\p{N}_]', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS slug FROM web_records""",
    "t9_text_hash": f"SELECT doc_id, {_HASH.format('url', chr(39) + '0' + chr(39), 'text')} AS content_hash FROM documents",
    "t10_token_counts": f"SELECT doc_id, CAST(len({tok('text')}) AS INTEGER) AS tokens, CAST(len(list_distinct({tok('text')})) AS INTEGER) AS distinct_tokens FROM documents WHERE text IS NOT NULL",
    "t12_term_frequencies": f"""
SELECT doc_id, token, count(*) AS n, round(count(*) / any_value(len), 9) AS tf FROM
  (SELECT doc_id, len(ts) AS len, unnest(ts) AS token FROM (SELECT doc_id, {tok('text')} AS ts FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id, token""",
    "t15_first_percent": r"""
SELECT record_id, coalesce(nullif(regexp_extract(page_content, '([0-9]+(?:[.,][0-9]+)?)\s*<sub>\s*%\s*</sub>', 1), ''),
  nullif(regexp_extract(regexp_replace(page_content, '<[^>]*>', ' ', 'g'), '(\d+[,.]\d+)\s*%', 1), '')) AS rate FROM page_captures""",
    "t16_links": r"""
WITH l AS (SELECT record_id, url, unnest(regexp_extract_all(page_content, '(?i)<a\b[^>]*?\shref\s*=\s*"([^"]+)"', 1)) AS link FROM page_captures)
SELECT record_id, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
  WHEN starts_with(link, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*)', 1) || link
  ELSE regexp_replace(url, '[^/]*$', '') || link END AS link, count(*) AS n FROM l GROUP BY ALL""",
    "t22_first_lines": r"""
SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^["''„”]+|["''„”]+$', '', 'g')), lambda x: x <> '')[1] AS line FROM documents""",
    "t23_context_blocks": """
SELECT doc_id, '[1] ' || coalesce(nullif(source, ''), '?') || ' | ? | ' || coalesce(strftime(published_at, '%Y-%m-%d'), '?') || ' | ' || substr(coalesce(nullif(title, ''), '?'), 1, 60)
  || chr(10) || substr(coalesce(text, ''), 1, 800) AS block FROM documents""",
    "min_length_filter": f"SELECT doc_id, source FROM documents WHERE length({_STRIP.format('text')}) >= 200",
    "url_and_title_filters": """
WITH f AS (SELECT source, coalesce(contains(url, '/blog/') OR contains(url, 'utm_'), false) AS s,
  coalesce(len(list_filter(topics, lambda t: contains(lower(title), lower(t)))) > 0, false) AS m FROM web_records)
SELECT source, count(*) FILTER (s) AS skipped_url, count(*) FILTER (NOT s AND NOT m) AS skipped_title, count(*) FILTER (NOT s AND m) AS kept FROM f GROUP BY source""",
    "j1_new_openings": _HASHED + " SELECT DISTINCT content_hash FROM h WHERE batch_no > 0 AND content_hash NOT IN (SELECT content_hash FROM h WHERE batch_no = 0)",
    "a10_opening_counts": _HASHED
    + """
SELECT coalesce(source, 'unknown') AS source, count(*) FILTER (NOT k) AS new_chunks, count(*) FILTER (k) AS duplicate_chunks FROM
  (SELECT source, content_hash IN (SELECT content_hash FROM h WHERE batch_no = 0) AS k FROM h WHERE batch_no > 0) GROUP BY 1""",
    "j6_dense_topk": "WITH " + _DENSE.format(name="de", queries="SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0") + " SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM de",
    "j7_sparse_topk": "WITH " + _SPARSE + " SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM sp",
    "j3_fused_topk": _FUSED + " SELECT qid, id, CAST(rank AS INTEGER) AS rank, CAST(coalesce(dense_rank, 0) AS INTEGER) AS dense_rank, CAST(coalesce(sparse_rank, 0) AS INTEGER) AS sparse_rank, round(score, 9) AS score FROM fu",
    "j4_hybrid_search": _HYDRATED + " SELECT qid, CAST(rank AS INTEGER) AS rank, id, source, title, round(score, 9) AS score FROM hy",
    "w5_reranked": _HYDRATED
    + """
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(grade, 9) DESC, rank) AS INTEGER) AS rerank_rank, round(grade, 6) AS rerank_score FROM gr QUALIFY rerank_rank <= 6""",
    "w6_unranked": _FUSED + " SELECT qid, id, CAST(rank AS INTEGER) AS rank FROM fu WHERE rank <= 6",
    "source_filter_advice": "SELECT source, count(*) AS documents FROM documents WHERE source IN (SELECT source FROM source_manifest WHERE content_type = 'blog_html') GROUP BY source",
    "a1_source_counts": "SELECT coalesce(source, 'unknown') AS source, count(*) AS chunks FROM documents GROUP BY 1",
    "a2_domain_inventory": f"""
WITH u AS (SELECT coalesce({_NETLOC.format('url')}, nullif(source, ''), 'unknown') AS domain, url AS u, count(*) AS n FROM web_records GROUP BY ALL)
SELECT domain, count(u) AS urls, CAST(sum(n) AS BIGINT) AS chunks FROM u GROUP BY ROLLUP (domain)""",
    "a3_grade_summary": _HYDRATED
    + """,
s AS (SELECT qid, avg(grade) AS a, bool_or(coalesce(published_at < TIMESTAMP '2024-07-01', false)) AS stale FROM gr GROUP BY qid)
SELECT qid, round(a, 6) AS avg_score, stale, a < 0.6 OR (stale AND a < 0.85) AS retry FROM s""",
    "a12_retrieval_metrics": "WITH "
    + _SPARSE
    + """,
rel AS (SELECT DISTINCT g.qid, d.doc_id AS id FROM (SELECT item_id AS qid, unnest(expected_source_domains) AS source FROM golden_questions) g JOIN documents d USING (source)),
f AS (SELECT qid, count(*) AS hits, min(rank) AS first FROM sp JOIN rel USING (qid, id) GROUP BY qid)
SELECT qid, count(*) AS relevant, round(coalesce(any_value(hits), 0) / count(*), 6) AS recall, round(coalesce(any_value(hits), 0) / 12, 6) AS precision,
  round(coalesce(CAST(1 AS DOUBLE) / any_value(first), 0), 6) AS reciprocal_rank FROM rel LEFT JOIN f USING (qid) GROUP BY qid""",
    "a12_answer_checks": "WITH "
    + _SPARSE
    + """
SELECT sp.qid, len(list_filter(coalesce(expected_answer_contains, []), lambda s: NOT contains(lower(d.text), lower(s)))) = 0 AS contains_all,
  len(list_filter(coalesce(should_not_contain, []), lambda s: contains(lower(d.text), lower(s)))) = 0 AS contains_none,
  coalesce(list_contains(expected_source_domains, d.source), false) AS domain_hit
FROM sp JOIN documents d ON d.doc_id = sp.id JOIN golden_questions g ON g.item_id = sp.qid WHERE rank = 1""",
    "w7_last_rows": "SELECT source_id, record_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY record_id DESC) AS INTEGER) AS back FROM web_records WHERE source_id IS NOT NULL QUALIFY back <= 10",
    "w11_latest_values": "SELECT user_id, value, event_id FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "r3_thread_history": """
WITH r AS (SELECT source_id, record_id, row_number() OVER (PARTITION BY source_id ORDER BY record_id DESC) AS n, count(*) OVER (PARTITION BY source_id) AS turns FROM web_records WHERE source_id IS NOT NULL)
SELECT any_value(turns) AS turns, string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY record_id) AS history FROM r WHERE n <= 10 GROUP BY source_id""",
    "r4_event_windows": """
WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
    "s6_robots_gate": f"""
WITH r AS (SELECT {_NETLOC.format('url')} AS authority, bool_or(language = 'pl') AS polish FROM source_manifest GROUP BY 1),
w AS (SELECT record_id, {_NETLOC.format('url')} AS authority, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]*([^#]*)', 1) AS p FROM web_records)
SELECT record_id, CASE WHEN r.authority IS NULL THEN true WHEN coalesce(polish, false) THEN NOT starts_with(p, '/blog/') OR starts_with(p, '/blog/20')
  ELSE NOT (starts_with(p, '/') AND contains(p, '?')) END AS allowed
FROM w LEFT JOIN r ON w.authority = r.authority""",
    "site_plan": r"""
WITH l AS (SELECT DISTINCT source_id, url AS page, unnest(regexp_extract_all(page_content, '(?i)<a\b[^>]*?\shref\s*=\s*"([^"]+)"', 1)) AS link FROM page_captures),
c AS (SELECT DISTINCT source_id, page, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
  WHEN starts_with(link, '//') THEN regexp_extract(page, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || link
  WHEN starts_with(link, '/') THEN regexp_extract(page, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*)', 1) || link
  ELSE regexp_replace(page, '[^/]*$', '') || link END AS url FROM l),
f AS (SELECT DISTINCT source_id, url FROM c WHERE source_id IS NOT NULL AND url IS NOT NULL
  AND nullif(regexp_extract(page, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)', 1), '') = nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)', 1), '')
  AND NOT contains(url, '/tag/') AND NOT contains(url, 'utm_') AND NOT contains(url, '#')
  AND url NOT IN (SELECT url FROM web_records WHERE url IS NOT NULL))
SELECT source_id, url, CAST(row_number() OVER (PARTITION BY source_id ORDER BY url) AS INTEGER) AS n FROM f QUALIFY n <= 20""",
    "filtered_search": f"""
WITH q AS (SELECT DISTINCT item_id AS qid, unnest({tok("question")}) AS token FROM golden_questions),
d AS (SELECT record_id AS doc_id, {tok("page_content")} AS ts FROM web_records WHERE page_content IS NOT NULL AND year IN (2023, 2024) AND content_type IN ('blog_html', 'pdf_local')),
p AS (SELECT doc_id, len, token, count(*) AS n FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS token FROM d) GROUP BY ALL),
tf AS (SELECT doc_id, token, n / len AS tf FROM p WHERE token IN (SELECT token FROM q)),
st AS (SELECT token, ln(((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY token),
sc AS (SELECT qid, doc_id AS id, sum(idf * tf) AS score FROM tf JOIN st USING (token) JOIN q USING (token) GROUP BY qid, doc_id)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM sc QUALIFY rank <= 12""",
    "k4_keyword_index": "WITH " + _SPARSE + " SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM sp",
    "k5_page_blocks": """
WITH p AS (SELECT url, page, arg_min(page_content, record_id) AS t FROM page_records WHERE page_content IS NOT NULL AND page IS NOT NULL GROUP BY url, page)
SELECT url, string_agg('--- Page ' || page || ' ---' || chr(10) || t, chr(10) ORDER BY page) AS text FROM p GROUP BY url""",
    "j5_manifest_metadata": """
SELECT d.doc_id, d.source, m.author, m.language FROM documents d
LEFT JOIN (SELECT * FROM source_manifest QUALIFY row_number() OVER (PARTITION BY source ORDER BY source_id DESC) = 1) m ON d.source = m.source""",
    "j8_latest_known": """
WITH n AS (SELECT CAST(year(published_at) AS INTEGER) AS year, count(*) AS n FROM documents WHERE published_at IS NOT NULL GROUP BY 1)
SELECT w.record_id, coalesce(n.n, (SELECT arg_max(n, year) FROM n)) AS n FROM web_records w LEFT JOIN n ON n.year = w.year""",
    "j11_most_trusted": """
SELECT source, doc_id, content_type, CAST(coalesce(list_position(['legal_text', 'pdf_gov', 'pdf_local'], content_type), 4) AS INTEGER) AS trust
FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(list_position(['legal_text', 'pdf_gov', 'pdf_local'], content_type), 4), doc_id) = 1""",
    "t21_keyword_routes": r"""
SELECT doc_id, coalesce(regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(konto|rachunek|account)($|[^\p{L}\p{N}_])'), false) AS asks_account,
  coalesce(regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(pozycji|about)($|[^\p{L}\p{N}_])'), false) AS asks_item,
  coalesce(regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(stawka|próg|rate)($|[^\p{L}\p{N}_])'), false) AS asks_rate FROM documents""",
}
