"""SQL of the queries on runs and on sources."""
from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def crc32(value: str) -> str:
    """The unsigned crc32 of a column as decimal text; null for null."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: {step})"
    codes = f"list_transform(range(1, len(CAST({value} AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST({value} AS VARCHAR), i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), CAST(4294967295 AS BIGINT))"


# Equal grams of 16 words at a lag: runs of that lag have at least 16 words that repeat.
PERIODIC = f"""
WITH raw AS (SELECT doc_id, {crc32('doc_id')} AS h, {WORDS} AS w FROM documents),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM raw),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
planted AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
  list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM placed),
grams AS (SELECT doc_id, n, unnest(range(n - 15)) AS i, unnest(list_transform(range(1, n - 14), lambda i: md5(array_to_string(w[i:i + 15], ' ')))) AS k
  FROM planted WHERE n >= 24),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 15 + q AS l FROM islands GROUP BY doc_id, q, island),
long AS (SELECT * FROM stretches WHERE l >= greatest(24, 3 * q)),
runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) AS r FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listing FROM runs GROUP BY doc_id),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM planted),
dropped AS (SELECT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS c FROM one ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
  sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM planted p LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.doc_id = p.doc_id
LEFT JOIN listed ON listed.doc_id = p.doc_id LEFT JOIN kept ON kept.doc_id = p.doc_id
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_F = "(p - q) * (p - q) // q"


def _share(n: str, total: str) -> str:
    return f"CAST(1 + (CAST(1000000000 AS HUGEINT) * ({n} + 1)) // ({total} + v) AS BIGINT)"


SOURCES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
one AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM one GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sized AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM one JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_share('coalesce(n, 0)', 'total')} AS p, {_share('all_n', 'all_total')} AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sized s ON s.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
met AS (SELECT x.lang, x.source, y.source AS item, x.p, y.p AS q FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source),
summed AS (SELECT lang, source, item, sum({_F}) AS value FROM met GROUP BY lang, source, item),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {_F} AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
