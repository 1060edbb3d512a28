"""DuckDB text of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"'[\x20\x09-\x0D]+'"
BREAK = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def words(text: str, at: str) -> str:
    return f"list_filter(string_split_regex({text}, {at}), lambda x: x <> '')"


OP1 = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g
    FROM (SELECT doc_id, {words(LOWER, SPACE)} AS w FROM documents)),
  one AS MATERIALIZED (SELECT min(doc_id) AS id, g, len(g) AS n, count(*) AS k FROM s WHERE len(g) > 0 GROUP BY g),
  x AS MATERIALIZED (SELECT id, n, unnest(g) AS t FROM one),
  l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.t = b.t AND a.id <> b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  r AS (SELECT id AS a, id AS b FROM one UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a, min(b) AS comp FROM r GROUP BY a)
  SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(comp, doc_id) AS component_id, coalesce(k, 1) AS n_copies
  FROM s LEFT JOIN one ON s.g = one.g LEFT JOIN c ON c.a = one.id"""

OP3 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
  q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS best,
    array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST((CAST('0x' || h[1 + 10 * (i // 8):10 + 10 * (i // 8)] AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER)]), '') AS payload_digest FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN best <> page_id THEN best END AS refers_to FROM q"""

OP5 = r"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
  b AS (SELECT page_id, max({'n': length(rh || rp), 'r': rh || rp, 'v': v}) AS m FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
  SELECT u.page_id, host, path, m.r AS rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN b USING (page_id)"""

OP6 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {words(LOWER, BREAK)} AS w FROM documents),
  i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words(LOWER, BREAK)} AS w FROM benchmark),
  iw AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
  dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
  m AS MATERIALIZED (SELECT doc_id, s, n, item FROM dw JOIN iw USING (n, t)),
  h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
  k AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP7 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(2 * length(text) - length(regexp_replace(text, '[\\<\[\]]', '', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 14 WHEN 'system' THEN 17
      ELSE 16 + 2 * length(role) - length(regexp_replace(role, '[\\<\[\]]', '', 'g')) END) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

OP9 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {words("coalesce(text, '')", SPACE)} AS w FROM documents),
  x AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
  again AS (SELECT doc_id, s FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM again),
  kept AS (SELECT doc_id, count(*) AS n, sha256(string_agg(w, ' ' ORDER BY p)) AS h FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, coalesce(h, sha256('')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH d AS (SELECT doc_id, source, CAST(len({words("coalesce(text, '')", SPACE)}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
  p AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s),
  r AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio FROM p),
  l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(CAST(cap AS DOUBLE)) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level,
    row_number() OVER (ORDER BY ratio, pos) AS nth FROM r WINDOW o AS (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT arg_min(level, nth) AS level FROM l WHERE level < ratio),
  t AS (SELECT source, source_size, round(CASE WHEN f.level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), f.level * w) END, 6) AS target FROM l, f),
  k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
  c AS (SELECT d.*, source_size, target, whole, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS upto FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
  e AS (SELECT *, CASE WHEN source_size > 0 AND upto - CAST(size AS DOUBLE) / 2 <= target - whole * source_size THEN 1 ELSE 0 END AS more FROM c)
  SELECT doc_id, source, size, source_size, target, CASE WHEN size > 0 THEN whole + more END AS copies, (whole + more) * size AS taken FROM e"""

LETTERS = r"'[\x00-\x40\x5B-\x60\x7B-\x7F]+'"
OP11 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {words(LOWER, LETTERS)} AS w FROM documents),
  c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
  k AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
  g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
  v AS MATERIALIZED (SELECT lang, count(*) AS kept, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang),
  dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS BIGINT) AS own
    FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  m AS MATERIALIZED (SELECT dense.lang, source, term, dense.n, 1 + (1000000000 * (dense.n + 2)) // (own + 2 * kept) AS p FROM dense JOIN v ON v.lang = dense.lang),
  f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
    FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
  terms AS (SELECT m.lang, source, 'term' AS part, m.term AS item, (p - q) * (p - q) // (p + q) AS value
    FROM m JOIN (SELECT k.lang, term, 1 + (1000000000 * (n + 2)) // (total + 2 * kept) AS q FROM k JOIN v ON k.lang = v.lang) l ON l.lang = m.lang AND l.term = m.term WHERE n > 0 AND p > q),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
  SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""

ORACLES = {"op1_ngram_join": OP1, "op3_warc": OP3, "op5_url_filter": OP5, "op6_decontam": OP6, "op7_chat_format": OP7, "op9_substring_dedup": OP9, "op10_mixing": OP10,
           "op11_source_divergence": OP11}
