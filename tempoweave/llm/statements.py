"""DuckDB statements of the text queries that SQL can say: plain readings of their contracts."""

from __future__ import annotations

_BLANKS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Each byte as two hexadecimal digits; a string of 100 bytes counts as late if it starts earlier as well.
REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS pos FROM d),
k AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 2) AS byte, CASE WHEN 2 * pos + 200 <= length(h) THEN md5(substr(h, 2 * pos + 1, 200)) END AS key FROM p),
l AS (SELECT doc_id, pos, byte, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 AS late FROM k),
g AS (SELECT *, max(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM l),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS opens FROM g),
a AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, count(CASE WHEN opens THEN 1 END) AS o, coalesce(string_agg(byte, '' ORDER BY pos) FILTER (gone = 0), '') AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(o, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

REPEATED_WORDS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 49 <= len(w) THEN md5(array_to_string(w[pos:pos + 49], ' ')) END AS key FROM p),
l AS (SELECT doc_id, pos, word, key IS NOT NULL AND min(doc_id) OVER (PARTITION BY key) < doc_id AS late FROM k),
g AS (SELECT *, max(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM l),
a AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

_TEST_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
CONTAMINATED = f"""
WITH d AS (SELECT doc_id, {_TEST_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TEST_WORDS} AS w FROM benchmark),
i AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item, m, array_to_string(w[pos:pos + m - 1], ' ') AS key FROM i), m AS (SELECT DISTINCT m FROM t),
p AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS pos FROM d, m WHERE len(w) >= m),
h AS (SELECT p.doc_id, p.pos, p.m, t.item FROM p JOIN t ON t.m = p.m AND t.key = array_to_string(p.w[p.pos:p.pos + p.m - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + m)) AS word FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SIMILAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANKS}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[pos:pos + 4], ' ')) AS g FROM p), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x.a, x.b FROM x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
