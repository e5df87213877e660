"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP2 = rf"""WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT q) AS q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN least USING (s) WHERE m < doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) u ANTI JOIN (SELECT doc_id, unnest(q) AS q FROM gone) g USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(q), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_CONTROL = " OR ".join(f"contains(x, '{s}')" for s in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
OP4 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, role || chr(10) || text AS x FROM t),
l AS (SELECT *, length(role) + length(text) + 17 + CASE WHEN {_CONTROL} THEN 3 + length(regexp_replace(x, '[^~<\\[]', '', 'g')) ELSE 0 END AS n FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(x || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM l GROUP BY conv_id"""

OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '00' AS s FROM pages),
e AS (SELECT page_id, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, 5 * i // 4 + 1, 3) AS INT) >> (7 - 5 * i % 4)) & 31) + 1 AS INT), 1) FOR i IN range(0, 32)], '') AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM e)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM f"""

OP9 = """WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) / (q.norm * c.norm) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP11 = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, doc_id, (CASE WHEN len(x) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(x)) < 80 * len(x) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails FROM w),
l AS (SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM f LEFT JOIN labels USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS own, substr(filter_order, 1, k - 1) AS before FROM o, range(1, 6) AS r(k)),
j AS (SELECT part, filter_order, step, own, good, bad, contains(fails, own) AS hit, length(before) > 0 AND length(translate(fails, before, '')) < length(fails) AS gone, fails = own AS alone FROM l, s),
g AS (SELECT part, filter_order, step, own, count(*) FILTER (NOT hit AND NOT gone) AS kept, count(*) FILTER (hit AND NOT gone) AS removed, count(*) FILTER (hit AND gone) AS redundant, count(*) FILTER (alone) AS unique_fails,
  count(*) FILTER (hit AND NOT gone AND good) AS good_lost, count(*) FILTER (hit AND NOT gone AND bad) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g"""

OP12 = r"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([CAST(b AS BIGINT)] || CAST(range(0, 8) AS BIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v FROM range(0, 256) AS r(b))),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY ALL),
x AS (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS hx FROM m),
y AS (SELECT r, n, xor(CAST(4294967295 AS BIGINT), list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(strpos('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 17 AS BIGINT) FOR i IN range(0, length(hx) // 2)],
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM x, tab),
z AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM y),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM z WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, a.n, b.word, b.n FROM w a JOIN d b ON a.word = b.s UNION SELECT b.word, b.n, a.word, a.n FROM w a JOIN d b ON a.word = b.s),
q AS (SELECT word, n, count(*) AS n_near, max(other_n) AS top FROM p GROUP BY ALL),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN q USING (word)),
g AS (SELECT f.*, (SELECT min(other) FROM p WHERE p.word = f.word AND p.other_n = f.form_n) AS form FROM f),
path AS (SELECT word, word AS root, 0 AS k FROM g UNION ALL SELECT path.word, g.form, k + 1 FROM path JOIN g ON g.word = path.root WHERE g.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM g JOIN (SELECT word, arg_max(root, k) AS root FROM path GROUP BY word) USING (word)"""

#: None for the others: classifiers, 64-bit hashes, merges and rings are tested against brute force.
SQL = {"op1_decontaminate": OP1, "op2_substring": OP2, "op4_chat": OP4, "op8_warc": OP8, "op9_neighbours": OP9, "op11_audit": OP11, "op12_variants": OP12}
