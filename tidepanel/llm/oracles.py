"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

import string

#: Smallest vertex reachable over the edges (a, b), both directions listed: recursion over pairs.
_REACH = """, reach(id, other) AS (SELECT a, b FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a),
named AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)"""

#: For pages built like those of the given tables: one article of headings and paragraphs, few character references.
OP1 = r"""WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)),
  '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN parts] AS parts FROM a)
SELECT page_id, url, array_to_string([x FOR x IN parts IF x <> ''], chr(10)) AS text, CAST(length(array_to_string([x FOR x IN parts IF x <> ''], chr(10))) AS BIGINT) AS n_chars FROM b"""

OP2 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
st AS (SELECT doc_id, list_sort(list_distinct(list(s))) AS st FROM sh GROUP BY 1),
cl AS (SELECT doc_id, len(st) AS n, min(doc_id) OVER (PARTITION BY st) AS rep FROM st),
one AS (SELECT st.doc_id, cl.n, unnest(st.st) AS s FROM st JOIN cl ON cl.doc_id = st.doc_id AND cl.rep = cl.doc_id),
prs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS (SELECT a, b FROM prs){_REACH}
SELECT w.doc_id, coalesce(cl.n, 0) AS n_shingles, coalesce(named.component, cl.rep, w.doc_id) AS component_id, coalesce(named.component, cl.rep, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN cl USING (doc_id) LEFT JOIN named ON named.id = cl.rep"""

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"

OP4 = f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE} AND len([1 FOR x IN embedding IF x <> 0]) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93){_REACH},
n AS (SELECT a, count(*) AS n FROM edges GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN named ON named.id = vec_id"""

OP5 = f"""WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '<turn', '\\<turn'), '</turn', '\\</turn')"

OP8 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, k, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(k, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn >') + 1 + length('</turn>') + 1 + length(replace({_ESCAPED.format('role')}, '>', '\\>')) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

#: crc32 step by step: the table of 256 remainders from its polynomial, then one byte of <doc_id>:<run> after another.
_CRC_TABLE = "[list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR i IN range(256)]"
_BYTES = "flatten([CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END FOR c IN string_split({0}, '')])"

OP11 = rf"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS k FROM r WHERE length(w) >= 6 GROUP BY 1, 2),
t AS (SELECT {_CRC_TABLE} AS t),
h AS (SELECT w, k, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || {_BYTES.format("doc_id || ':' || w")}, lambda c, b: xor(t[1 + CAST(xor(c % 256, b) AS INTEGER)], c // 256))) AS h FROM d, t),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS w, k FROM h),
words AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM s WHERE length(w) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
cuts AS (SELECT w, length(w) AS l, i, substr(w, 1, i - 1) || substr(w, i + 1) AS x FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
near AS (SELECT a.w AS a, b.w AS b FROM cuts a JOIN cuts b ON a.l = b.l AND a.i = b.i AND a.x = b.x AND a.w <> b.w
  UNION SELECT x, w FROM cuts WHERE x IN (SELECT w FROM words) UNION SELECT w, x FROM cuts WHERE x IN (SELECT w FROM words)),
best AS (SELECT * FROM (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM near JOIN words ON w = b) WHERE r = 1),
f AS (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * words.n THEN b END AS form, CASE WHEN best.n >= 5 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best ON a = words.w),
up AS (SELECT w, w AS z, 0 AS k FROM f UNION ALL SELECT up.w, f.form, k + 1 FROM up JOIN f ON f.w = up.z WHERE f.form IS NOT NULL)
SELECT f.w AS word, form, root, n, n_near, form_n FROM f JOIN (SELECT w, arg_max(z, k) AS root FROM up GROUP BY 1) USING (w)"""
