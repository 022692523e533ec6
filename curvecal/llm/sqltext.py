"""DuckDB SQL of the corpus queries that SQL can express."""

R6 = "round({}, 6)"

_LEVELS = """
p AS (SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
o AS (SELECT p.host, l.quality AS good FROM p JOIN labels l
  ON l.doc_id = TRY_CAST(regexp_extract(p.path, '/([0-9]+)[^/0-9]*/?$', 1) AS BIGINT) WHERE l.quality IS NOT NULL),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS s FROM o GROUP BY host),
d AS (SELECT regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, sum(n) AS n, sum(s) AS s FROM h GROUP BY 1),
x AS (SELECT regexp_extract(host, '[^.]*$') AS suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY 1),
u AS (SELECT 'h' AS level, n, s FROM h UNION ALL SELECT 'd', n, s FROM d UNION ALL SELECT 'x', n, s FROM x),
m AS (SELECT level, sum(n) AS n, sum(s) AS s, count(*) AS k, sum(n * n) AS n2, sum(s * s / n) AS s2, sum(s) / sum(n) AS p FROM u GROUP BY level),
b AS (SELECT *, p * (1 - p) AS chance, n - n2 / n - (k - 1) AS spread FROM m),
c AS (SELECT level, CASE WHEN k < 2 OR chance <= 0 OR spread <= 0 THEN 10.0
    ELSE CASE WHEN (s2 - n * p * p - chance * (k - 1)) / (chance * spread) > 0
      THEN least(10000.0, greatest(1.0, 1 / ((s2 - n * p * p - chance * (k - 1)) / (chance * spread)) - 1)) ELSE 10000.0 END END AS strength FROM b),
g AS (SELECT coalesce((SELECT strength FROM c WHERE level = 'h'), 10.0) AS kh, coalesce((SELECT strength FROM c WHERE level = 'd'), 10.0) AS kd,
  coalesce((SELECT strength FROM c WHERE level = 'x'), 10.0) AS kx, coalesce((SELECT (sum(s) + 1) / (sum(n) + 2) FROM h), 0.5) AS rate),
a AS (SELECT q.host, coalesce(h.n, 0) AS n, coalesce(h.s, 0) AS s, coalesce(d.n, 0) AS dn, coalesce(d.s, 0) AS ds, coalesce(x.n, 0) AS xn, coalesce(x.s, 0) AS xs
  FROM (SELECT DISTINCT host FROM p) q LEFT JOIN h USING (host)
  LEFT JOIN d ON d.domain = regexp_extract(q.host, '([^.]*\\.)?[^.]*$') LEFT JOIN x ON x.suffix = regexp_extract(q.host, '[^.]*$')),
r AS (SELECT host, n, kh, (s + kh * ((ds + kd * ((xs + kx * rate) / (xn + kx))) / (dn + kd))) / (n + kh) AS rate FROM a, g),
v AS (SELECT host, n, rate, 2 * sqrt(rate * (1 - rate) / (n + kh + 1)) AS half FROM r)
"""
_FIT = "(p.host = '{0}' OR ends_with(p.host, '.{0}')) AND starts_with(p.path, '{1}')"
OP1 = f"""WITH {_LEVELS},
j AS (SELECT p.*, CASE WHEN {_FIT.format('example.net', '/en/')} THEN 'example.net/en/' WHEN {_FIT.format('example.com', '/de/')} THEN 'example.com/de/'
  WHEN {_FIT.format('org', '/fr/')} THEN 'org/fr/' WHEN {_FIT.format('net', '/')} THEN 'net/' END AS rule FROM p)
SELECT page_id, j.host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN rate + half < 0.5 THEN 'block' ELSE 'allow' END AS verdict, n::BIGINT AS n_labelled, {R6.format('rate')} AS rate,
  {R6.format('rate - half')} AS low, {R6.format('rate + half')} AS high FROM j JOIN v USING (host)"""

OP5 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id AND c.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id) m USING (doc_id)"""

OP9 = """WITH r AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.id AS query_id, r.id, (64 - list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)))::INT AS distance
  FROM r q, r WHERE q.id % 20 = 0)
SELECT query_id, rank::INT AS rank, id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 10"""

OP3 = """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
h AS (SELECT doc_id, hex(raw) AS x, n FROM t),
w AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS k FROM h WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.k FROM w JOIN f ON w.s = f.s AND f.first < w.doc_id),
e AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM g),
b AS (SELECT doc_id, k, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM e),
r AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS z FROM b GROUP BY doc_id, run),
p AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends, sum(z - a)::BIGINT AS gone, count(*) AS runs FROM r GROUP BY doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE array_to_string(list_transform(range(1, runs::BIGINT + 2), lambda i:
    substr(x, (2 * CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END + 1)::BIGINT,
      (2 * (CASE WHEN i = runs + 1 THEN h.n ELSE starts[i] END - CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END))::BIGINT)), '') END)) AS kept_sha256
FROM h LEFT JOIN p USING (doc_id)"""


# crc32 of a number's decimal form: the register takes each byte and then moves eight times (marked by -1).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(s) + 1),
    lambda i: list_prepend(ord(s[i])::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"""

OP12 = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, CAST(conv_id AS VARCHAR) AS s FROM t),
h AS (SELECT conv_id, base, {_CRC} % 6 AS head FROM c),
r AS (SELECT h.conv_id, 0 AS own, pos, role, text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.head
  UNION ALL SELECT h.conv_id, 1, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id WHERE t.pos > h.head),
q AS (SELECT conv_id, row_number() OVER w AS d, length(text) AS len,
  sha256(string_agg(length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '') OVER w) AS key
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, 0 AS d, '' AS key, 0 AS len FROM h UNION ALL SELECT conv_id, d, key, len FROM q),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, max(len) AS len FROM m GROUP BY d, key),
k AS (SELECT p.d, p.key, count(*) AS kids FROM n JOIN m p ON p.conv_id = n.conv_id AND p.d = n.d - 1 GROUP BY p.d, p.key),
u AS (SELECT p.d, p.key, count(*) FILTER (WHERE k.kids IS NULL) AS leaves, sum((n.n - 1) * n.len) AS saved
  FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key JOIN m p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.key),
l AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
e AS (SELECT m.d, m.key, sha256(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS ends
  FROM m JOIN l ON l.conv_id = m.conv_id AND l.d = m.d GROUP BY m.d, m.key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs,
  CAST(coalesce(k.kids, 0) AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN u USING (d, key) LEFT JOIN k USING (d, key) LEFT JOIN e USING (d, key)
LEFT JOIN m p ON p.conv_id = n.conv_id AND p.d = n.d - 1 LEFT JOIN n a ON a.d = p.d AND a.key = p.key"""

OP13 = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""
