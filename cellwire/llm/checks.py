"""SQL of the registered queries, for those that SQL can express."""
from __future__ import annotations

from cellwire.llm.licenses import TEMPLATES, THRESHOLD

_SLOTS, _SHARDS = 8191, 64
_NAMES = ", ".join(f"'shard-{k:02d}'" for k in range(_SHARDS))


def _hashed(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


SHARDING = f"""
WITH RECURSIVE names AS (SELECT unnest([{_NAMES}]) AS s),
orders AS (SELECT row_number() OVER (ORDER BY s) - 1 AS i, s, {_hashed("s || '#1'")} % {_SLOTS} AS o, {_hashed("s || '#2'")} % {_SLOTS - 1} + 1 AS k FROM names),
lists AS (SELECT list(o ORDER BY i) AS o, list(k ORDER BY i) AS k, list(s ORDER BY i) AS s FROM orders),
fill AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(range({_SLOTS}), lambda x: CAST(-1 AS BIGINT)) AS taken, list_transform(range({_SHARDS}), lambda x: CAST(0 AS BIGINT)) AS nxt
  UNION ALL
  SELECT t + 1,
    list_transform(taken, lambda x, p: CASE WHEN p = (o[i] + j * k[i]) % {_SLOTS} + 1 THEN i - 1 ELSE x END),
    list_transform(nxt, lambda x, p: CASE WHEN p = i THEN j + 1 ELSE x END)
  FROM (SELECT t, taken, nxt, o, k, t % {_SHARDS} + 1 AS i,
          list_filter(range(nxt[t % {_SHARDS} + 1], {_SLOTS}), lambda j: taken[(o[t % {_SHARDS} + 1] + j * k[t % {_SHARDS} + 1]) % {_SLOTS} + 1] < 0)[1] AS j
        FROM fill, lists WHERE t < {_SLOTS})
),
slots AS (SELECT unnest(range({_SLOTS})) AS slot, unnest(taken) AS owner FROM fill WHERE t = {_SLOTS})
SELECT doc_id, CAST(slot AS INTEGER) AS slot, l.s[owner + 1] AS shard
FROM documents JOIN slots ON slot = {_hashed("coalesce(CAST(doc_id AS VARCHAR), '')")} % {_SLOTS}, lists l
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())


def _bigrams(text: str) -> str:
    words = f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"(SELECT list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM (SELECT {words} AS ws))"


LICENSES = f"""
WITH template AS (SELECT license, {_bigrams('body')} AS own FROM (VALUES {_TEMPLATES}) v(license, body)),
t AS (SELECT license, len(own) AS size, unnest(own) AS bigram FROM template),
lines AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
parts AS (SELECT doc_id, 0 AS unit, text AS part FROM lines WHERE len(l) > 1
  UNION ALL SELECT doc_id, unnest(range(1, len(l) + 1)), unnest(l) FROM lines),
units AS (SELECT doc_id, unit, {_bigrams('part')} AS own FROM parts),
spread AS (SELECT doc_id, unit, len(own) AS n, unnest(own) AS bigram FROM units),
scored AS (SELECT doc_id, unit, license, 2.0::DOUBLE * count(*) / (n + size) AS score
  FROM spread JOIN t USING (bigram) GROUP BY doc_id, unit, license, n, size HAVING 2.0::DOUBLE * count(*) / (n + size) >= {THRESHOLD}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM scored),
best AS (SELECT doc_id, license, score FROM ranked WHERE r = 1),
total AS (SELECT doc_id, count(DISTINCT unit) AS n_units FROM scored GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_units, 0) AS n_units
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN total ON d.doc_id = total.doc_id
"""

_VALID = """valid AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda x, y: x + y)"


NEAREST = f"""
WITH {_VALID},
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, {_dot('q.e', 'c.e')} AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""

LINKED = f"""
WITH RECURSIVE {_VALID},
unit AS (SELECT vec_id, e, sqrt({_dot('e', 'e')}) AS norm FROM valid),
pairs AS (SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE {_dot('a.e', 'b.e')} / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
links AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.u = vec_id LEFT JOIN links ON links.u = vec_id
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sets AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
pairs AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v),
least AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u),
links AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links, doc_id = class_id AS kept
FROM documents JOIN least ON least.u = doc_id LEFT JOIN links ON links.u = doc_id
"""

REMOVED_WORDS = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
one AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM words),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS k
  FROM words WHERE len(ws) >= 50),
least AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k),
hits AS (SELECT doc_id, p FROM windows JOIN least USING (k) WHERE d < doc_id),
marked AS (SELECT one.doc_id, w, one.p, max(h.p) OVER (PARTITION BY one.doc_id ORDER BY one.p) AS last
  FROM one LEFT JOIN hits h ON h.doc_id = one.doc_id AND h.p = one.p),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS s FROM marked WHERE last IS NULL OR p > last + 49 GROUP BY doc_id)
SELECT words.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""

REMOVED_BYTES = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
one AS (SELECT doc_id, unnest(range(length(h) // 2)) AS p, unnest(list_transform(range(length(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) AS b FROM raw),
windows AS (SELECT doc_id, unnest(range(length(h) // 2 - 49)) AS p, unnest(list_transform(range(length(h) // 2 - 49), lambda i: md5(substr(h, 2 * i + 1, 100)))) AS k
  FROM raw WHERE length(h) >= 100),
least AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k),
hits AS (SELECT doc_id, p FROM windows JOIN least USING (k) WHERE d < doc_id),
marked AS (SELECT one.doc_id, b, one.p, max(h.p) OVER (PARTITION BY one.doc_id ORDER BY one.p) AS last
  FROM one LEFT JOIN hits h ON h.doc_id = one.doc_id AND h.p = one.p),
gone AS (SELECT *, coalesce(p <= last + 49, false) AS g FROM marked),
runs AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM gone),
kept AS (SELECT doc_id, count(*) FILTER (g) AS n, count(*) FILTER (starts) AS spans, string_agg(b, '' ORDER BY p) FILTER (NOT g) AS s FROM runs GROUP BY doc_id)
SELECT raw.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(s, ''))) AS kept_sha256
FROM raw LEFT JOIN kept ON kept.doc_id = raw.doc_id
"""
