"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM shingled
), members AS (SELECT doc_id, unnest(s) AS shingle FROM shingled
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.seen
), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least ON node = doc_id
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS ord FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (SELECT source, source_size, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS n FROM totals
), weighed AS (SELECT *, [5, 2, 1][n % 3 + 1] AS weight, source_size * 3 AS lim FROM placed
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed) - coalesce(sum(lim) OVER before, 0)) / sum(weight) OVER rest AS level FROM weighed
  WINDOW before AS (ORDER BY lim / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY lim / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), water AS (SELECT level FROM levels WHERE level * weight <= lim ORDER BY lim / weight, n LIMIT 1
), targets AS (SELECT source, n, source_size, coalesce(least(weight * (SELECT level FROM water), CAST(lim AS DOUBLE)), 0.0) AS target FROM weighed
), shares AS (
  SELECT n, CAST(floor(coalesce(sum(target) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / sum(target) OVER () * 2147483648 + 0.5) AS BIGINT) AS lo,
    CAST(floor(sum(target) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () * 2147483648 + 0.5) AS BIGINT) AS hi
  FROM targets WHERE target > 0
), slots AS (SELECT slot, (slot % 2147483648 * 1327217885) % 2147483648 AS point FROM range((SELECT CAST((sum(source_size) + 127) // 128 AS BIGINT) FROM totals)) t(slot)
), ranked AS (SELECT n, row_number() OVER (PARTITION BY n ORDER BY slot) - 1 AS rnk FROM slots JOIN shares ON lo <= point AND point < hi
), turns AS (
  SELECT n, rnk % ((source_size + 127) // 128) AS block, count(*) AS times FROM ranked JOIN targets USING (n) WHERE rnk < 3 * ((source_size + 127) // 128) GROUP BY 1, 2
), laid AS (
  SELECT doc_id, n, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY n ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source WHERE size > 0
), cut AS (SELECT *, unnest(range(CAST(start // 128 AS BIGINT), CAST((start + size - 1) // 128 + 1 AS BIGINT))) AS block FROM laid
), taken AS (
  SELECT doc_id, size, source_size, target, c.n, start, coalesce(sum((least(start + size, (c.block + 1) * 128) - greatest(start, c.block * 128)) * times), 0) AS taken
  FROM cut c LEFT JOIN turns t ON t.n = c.n AND t.block = c.block GROUP BY ALL
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM taken
UNION ALL SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source WHERE size = 0
"""

WARC = r"""
WITH digested AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS least FROM digested)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM firsts
"""

URL_FILTER = r"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(of, start, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), named AS (SELECT row_number() OVER () AS r, * FROM split
), best AS (
  SELECT r, arg_max(of || start, length(of || start)) AS rule, arg_max(verdict, length(of || start)) AS by_rule
  FROM named JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY r
), cut AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM named LEFT JOIN best USING (r)
), rows AS (
  SELECT page_id, host, path, rule, by_rule, list_concat(list_transform(segments[1:32], lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END), CASE WHEN len(segments) > 32 THEN ['**'] ELSE [] END) AS shape FROM cut
), shapes AS (SELECT host, shape, count(*) AS urls, count(*) FILTER (by_rule = 'block') AS blocked, count(by_rule) AS labelled FROM rows GROUP BY 1, 2
), deep AS (SELECT *, unnest(range(1, len(shape) + 1)) AS depth FROM shapes
), nodes AS (SELECT *, shape[1:depth] AS node, CASE WHEN depth = len(shape) THEN 0 WHEN shape[depth + 1] IN ('*', '**') THEN 1 ELSE 2 END AS kind FROM deep
), tree AS (
  SELECT host, node, node[1 : len(node) - 1] AS parent, sum(urls) AS urls, sum(blocked) AS blocked, sum(labelled) AS labelled,
    sum(CASE WHEN kind = 0 THEN urls ELSE 0 END) AS below0, sum(CASE WHEN kind = 1 THEN urls ELSE 0 END) AS below1, sum(CASE WHEN kind = 2 THEN urls ELSE 0 END) AS below2
  FROM nodes GROUP BY 1, 2
), everywhere AS (SELECT node, parent, sum(blocked) AS b, sum(labelled) AS l FROM tree GROUP BY 1, 2
), tests AS (
  SELECT t.host, t.node, t.urls, sum(t.urls) OVER siblings AS all_urls,
    unnest([[t.blocked, t.labelled, sum(t.blocked) OVER siblings, sum(t.labelled) OVER siblings], [e.b, e.l, e.all_b, e.all_l], [t.below0, t.urls, sum(t.below0) OVER siblings, sum(t.urls) OVER siblings],
      [t.below1, t.urls, sum(t.below1) OVER siblings, sum(t.urls) OVER siblings], [t.below2, t.urls, sum(t.below2) OVER siblings, sum(t.urls) OVER siblings]]::DOUBLE[][]) AS c
  FROM tree t JOIN (SELECT *, sum(b) OVER (PARTITION BY parent) AS all_b, sum(l) OVER (PARTITION BY parent) AS all_l FROM everywhere) e ON e.node = t.node
  WINDOW siblings AS (PARTITION BY t.host, t.parent)
), apart AS (SELECT host, node, urls, all_urls, c, greatest(abs(c[1] * (c[4] - c[2]) - (c[3] - c[1]) * c[2]) - c[4] / 2, 0.0) AS d FROM tests
), steps AS (
  SELECT host, node, node[len(node)] AS segment, CASE WHEN segment IN ('*', '**') THEN segment
    WHEN any_value(urls) * 20 < any_value(all_urls) OR (any_value(urls) < any_value(all_urls) AND bool_and(d * d * c[4] <= 4.0 * c[3] * (c[4] - c[3]) * c[2] * (c[4] - c[2]))) THEN '*' ELSE segment END AS step
  FROM apart GROUP BY host, node
), built AS (
  SELECT n.host, shape, '/' || string_agg(step, '/' ORDER BY depth) AS template FROM nodes n JOIN steps s ON s.host = n.host AND s.node = n.node GROUP BY 1, 2
), template AS (SELECT s.*, coalesce(template, '/') AS template FROM shapes s LEFT JOIN built USING (host, shape)
), sums AS (SELECT host, template, sum(blocked) AS b, sum(labelled) AS n FROM template GROUP BY 1, 2
), wide AS (SELECT *, sum(b) OVER (PARTITION BY host) AS hb, sum(n) OVER (PARTITION BY host) AS hn, sum(b) OVER (PARTITION BY template) AS tb, sum(n) OVER (PARTITION BY template) AS tn FROM sums
), judged AS (
  SELECT host, template, (b + 2 * ((tb + 2 * ((hb + 2 * (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0.0) FROM sums)) / (hn + 2))) / (tn + 2))) / (n + 2) AS share FROM wide
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(share, 6) AS share
FROM rows JOIN template USING (host, shape) JOIN judged USING (host, template)
"""

ORACLES = {"op3_near_duplicates": NEAR_DUPLICATES, "op4_mixing": MIXING, "op7_warc": WARC, "op8_url_filter": URL_FILTER}
