"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOWER.format(c="regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE WHEN host = '' THEN NULL
WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule, '.' || host || chr(1) || path AS c FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN host = '' THEN 'allow'
WHEN contains(c, 'casino') OR contains(c, 'free-bets') OR contains(c, 'cheap-pills') OR contains(c, 'poker') OR contains(c, 'viagra') OR contains(c, 'porn') OR contains('.' || host, '.ads.') OR contains('.' || host, '.tracker.')
OR ends_with(c, '.exe') OR ends_with(c, '.zip') OR contains(c, '/wp-login') THEN 'block' ELSE 'allow' END AS verdict FROM f"""

OP5 = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(c="text")} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(c="coalesce(text, '')")} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM bw),
hit AS MATERIALIZED (SELECT doc_id, i, x.n, item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)) x JOIN bw ON bw.n = x.n AND bw.k = x.k),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
