"""Reference SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

# Entropy in whole millionths of c * log2(c), as the operator counts it: 24 characters
# a window, 3.0 bits for hexadecimal and 4.1 bits for base64 candidates.
_SECRETS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, name, pattern) AS (VALUES
  (0, 'assign', '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'),
  (2, 'hex', '[0-9a-f]+'),
  (3, 'entropy_hex', '[0-9a-fA-F]{24,}'),
  (4, 'entropy_base64', '[A-Za-z0-9+/_=-]{24,}')),
hits AS (
  SELECT r, kind, name, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS ps
  FROM docs, kinds WHERE regexp_matches(t, CASE kind WHEN 1 THEN 'AKIA[A-Z0-9]{16,}' WHEN 2 THEN '[0-9a-f]{24,}' ELSE pattern END)),
placed AS (
  SELECT r, kind, name, unnest(ms) AS m,
    unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(ps[1:i], lambda p: length(p)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0))) AS s
  FROM hits),
base AS (
  SELECT r, kind, name, s, s + length(m) AS e FROM placed
  WHERE (kind = 0 AND length(regexp_extract(m, '^(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6)
     OR (kind = 1 AND length(m) >= 20) OR (kind = 2 AND length(m) >= 24)),
windows AS (
  SELECT r, kind, name, s, m, unnest(range(0, length(m) - 23)) AS w FROM placed
  WHERE kind >= 3 AND NOT regexp_matches(m, '(?i)example|sample|placeholder|changeme|dummy|x{8}')
    AND NOT regexp_matches(m, '0123456789|(?i:abcdefghij)')
    AND NOT regexp_matches(m, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    AND NOT regexp_matches(m, '^[^0-9]*$')),
letters AS (
  SELECT r, kind, name, s, m, w, unnest(string_split(substr(m, CAST(w AS INT) + 1, 24), '')) AS ch FROM windows),
counts AS (SELECT r, kind, name, s, w, ch, count(*) AS c FROM letters GROUP BY ALL),
strong AS (
  SELECT r, kind, name, s, s + w AS a, s + w + 24 AS z FROM counts GROUP BY r, kind, name, s, w
  HAVING sum(CAST(round(c * log2(c) * 1000000) AS BIGINT))
    <= floor(24 * (log2(24) - CASE kind WHEN 3 THEN 3.0 ELSE 4.1 END) * 1000000)),
opened AS (
  SELECT *, CASE WHEN a > coalesce(max(z) OVER (PARTITION BY r, kind, s ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
    THEN 1 ELSE 0 END AS o FROM strong),
runs AS (SELECT *, sum(o) OVER (PARTITION BY r, kind, s ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM opened),
spans AS (
  SELECT r, kind, name, s, e FROM base
  UNION ALL SELECT r, kind, name, min(a), max(z) FROM runs GROUP BY r, kind, name, s, g),
folded AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN folded USING (r)
"""

_NGRAM_JOIN = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
  FROM docs),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_reached AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM sets LEFT JOIN least_reached ON a = doc_id
"""

# Six rounds of means, then one more assignment; eight parts, sixteen entries.
_KEPT = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT vec_id, label, (i - 1) // (len(v) // 8) AS part, (i - 1) % (len(v) // 8) AS place, v[i] AS x
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM kept)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16),
book0 AS MATERIALIZED (SELECT part, entry, place, x FROM cells JOIN firsts USING (vec_id))"""
_ASSIGN = """,
near{k} AS MATERIALIZED (
  SELECT vec_id, label, part, min({{'d': d, 'entry': entry}}) AS best
  FROM (SELECT c.vec_id, c.label, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
        FROM cells c JOIN book{k} b ON c.part = b.part AND c.place = b.place
        GROUP BY c.vec_id, c.label, c.part, b.entry)
  GROUP BY vec_id, label, part)"""
_MEANS = """,
book{next} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x) AS x
  FROM book{k} b LEFT JOIN (
    SELECT c.part, near.best.entry AS entry, c.place, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS n
    FROM cells c JOIN near{k} near ON c.vec_id = near.vec_id AND c.part = near.part
    GROUP BY c.part, near.best.entry, c.place) m
  ON m.part = b.part AND m.entry = b.entry AND m.place = b.place)"""
_CODES = """,
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near6 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book6) AS codebooks_sha256
FROM coded"""
_VECTOR_CODES = (
    _KEPT
    + "".join(_ASSIGN.format(k=k) + _MEANS.format(k=k, next=k + 1) for k in range(6))
    + _ASSIGN.format(k=6)
    + _CODES
)

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": _SECRETS,
    "op8_ngram_join": _NGRAM_JOIN,
    "op12_vector_codes": _VECTOR_CODES,
}
