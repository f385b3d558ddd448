r"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN host IN (SELECT f.x || t.x || '.example.' || l.x FROM (VALUES ('cheap-pills'), ('casino-win'), ('free-bets'), ('ads-track')) t(x),
    (VALUES (''), ('www.'), ('m.'), ('blog.'), ('shop.')) f(x), (VALUES ('com'), ('net'), ('org'), ('info')) l(x)) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

_WORDS8 = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = rf"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS8} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS words
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
runs AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS words
  FROM d, (SELECT DISTINCT size FROM win) s, unnest(range(1, len(w) - size + 2)) AS t(k) WHERE len(w) >= size),
hits AS (SELECT doc_id, runs.size, k, item_id FROM runs JOIN win ON runs.size = win.size AND runs.words = win.words),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS words FROM d, unnest(range(1, len(w) - 6)) AS t(k) WHERE len(w) >= 8),
twice AS (SELECT doc_id, words FROM win GROUP BY doc_id, words HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS place FROM win SEMI JOIN twice USING (doc_id, words)) GROUP BY doc_id),
line AS (
  SELECT doc_id, source, trim(regexp_replace(lower(x), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS x
  FROM (SELECT doc_id, source, unnest(lines) AS x FROM d)),
doc AS (SELECT doc_id, source, md5(array_to_string(list_sort(list(DISTINCT x)), chr(10))) AS h FROM line GROUP BY doc_id, source),
hot AS (SELECT source, x FROM line JOIN doc USING (doc_id, source) GROUP BY source, x HAVING count(DISTINCT h) > 50),
gone AS (SELECT doc_id, sum(len(string_split(x, ' '))) AS n FROM line SEMI JOIN hot USING (source, x) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_words - n_removed_words < 20 OR 100 * n_removed_words > 70 * n_words) AS kept
FROM f
"""

ORACLE = {"op7_url_cascade": OP7, "op8_decontaminate": OP8, "op10_quality_rules": OP10}
