"""DuckDB SQL of the queries, written from their contracts."""

from barloom.llm.license_scan import TEMPLATES

#: Words, lines and 8-word windows of every text; hosts shrunk with the moment estimate of a beta prior.
QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (SELECT w.rid, doc_id, host, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
    len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_same_next
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_same_next > 20 * n_words
      OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS own_failed FROM m),
h AS (SELECT host, count(*)::double AS n, (count(*) FILTER (base_failed OR own_failed))::double AS f FROM r GROUP BY host),
t AS (SELECT count(*) AS h, sum(n) AS n, sum(f) / sum(n) AS m, sum(n * n) AS n2, sum(f * f / n) AS f2n FROM h),
e AS (SELECT *, CASE WHEN m IN (0, 1) THEN 0 WHEN n - n2 / n - (h - 1) <= 0 THEN 0
    ELSE ((f2n - n * m * m) / (m * (1 - m)) - (h - 1)) / (n - n2 / n - (h - 1)) END AS rho FROM t),
s AS (SELECT m, CASE WHEN rho <= 1 / (1 + 1e6) THEN 1e6 ELSE 1 / least(rho, 1) - 1 END AS strength FROM e),
u AS (SELECT host, h.n, strength, (h.f + strength * m) / (h.n + strength) AS rate,
    coalesce((sum(h.f) OVER () - h.f) / nullif(sum(h.n) OVER () - h.n, 0), 1) AS others FROM h, s),
v AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)) > least(0.9, greatest(0.3, 2 * others)) AS rejected FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT own_failed AND NOT rejected AS kept, round(rate, 9) AS host_rate
FROM r JOIN v USING (host)"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html)::bigint AS payload_bytes, sha1(html) AS hx, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, (i // 8 * 10 + 1)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31)::int + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS verified
FROM d"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All windows of all texts, joined.
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
b2 AS (SELECT *, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM b2)),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b2) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, item_id, dw.m, i FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: Jaccard similarity of all pairs of distinct shingle sets with a common shingle; classes by a recursive walk.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))) AS sh
  FROM w WHERE len(ws) > 0),
k AS MATERIALIZED (SELECT min(doc_id) AS rep, count(*) AS copies, sh, len(sh) AS n FROM s GROUP BY sh),
e AS MATERIALIZED (SELECT rep, n, unnest(sh) AS g FROM k),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 5 * c >= 4 * (na + nb - c)),
walk(a, b) AS (SELECT a, b FROM l UNION SELECT walk.a, l.b FROM walk JOIN l ON walk.b = l.a),
cls AS (SELECT a, least(a, min(b)) AS root FROM walk GROUP BY a),
o AS (SELECT l.a, sum(copies) AS others FROM l JOIN k ON l.b = k.rep GROUP BY l.a)
SELECT w.doc_id, coalesce(cls.root, k.rep, w.doc_id) AS class_id, coalesce(k.copies - 1 + coalesce(others, 0), 0)::bigint AS n_links
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN k ON s.sh = k.sh LEFT JOIN cls ON cls.a = k.rep LEFT JOIN o ON o.a = k.rep"""

_TEMPLATE_ROWS = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))

#: Every line of every text against every template.
LICENCES = rf"""
WITH tpl(k, licence, text) AS (VALUES {_TEMPLATE_ROWS}),
tt AS (SELECT k, licence, t, count(*) AS tf FROM (SELECT k, licence, trim(unnest(string_split_regex(lower(text), '[^a-z0-9.]+')), '.') AS t FROM tpl) WHERE t <> '' GROUP BY ALL),
idf AS (SELECT t, ln((1 + (SELECT count(*) FROM tpl)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY t),
tv AS (SELECT k, licence, t, tf * idf AS w, sqrt(sum((tf * idf) ^ 2) OVER (PARTITION BY k)) AS n FROM tt JOIN idf USING (t)),
f AS (SELECT doc_id, text, '/' || coalesce(source, 'none') || '/p' || lpad((doc_id // 1000)::varchar, 5, '0') AS package, doc_id % 1000 // 50 AS m FROM documents),
files AS (SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN package ELSE package || '/m' || lpad(m::varchar, 2, '0') END AS dir,
  CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE 'f' || doc_id || '.txt' END AS name, package FROM f),
ln AS (SELECT DISTINCT dir || '/' || name AS path, i, line FROM (SELECT dir, name, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) - 1 AS i FROM files)),
lt AS (SELECT path, i, t, count(*) AS tf FROM (SELECT path, i, trim(unnest(string_split_regex(line, '[^a-z0-9.]+')), '.') AS t FROM ln) WHERE t <> '' GROUP BY ALL),
lv AS (SELECT path, i, t, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM tpl)) + 1) AS x FROM lt LEFT JOIN idf USING (t)),
nn AS (SELECT path, i, sqrt(sum(x * x)) AS n FROM lv GROUP BY ALL),
cs AS (SELECT lv.path, lv.i, tv.k, tv.licence, round(sum(x * w) / any_value(tv.n) / any_value(nn.n), 9) AS score
  FROM lv JOIN tv USING (t) JOIN nn ON nn.path = lv.path AND nn.i = lv.i GROUP BY ALL),
own AS (SELECT path, licence, score FROM cs WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence, i) = 1),
dl AS (SELECT dir, licence FROM (SELECT DISTINCT dir, dir || '/' || name AS path FROM files WHERE name = 'LICENSE') JOIN own USING (path))
SELECT doc_id, files.dir || '/' || name AS path, own.licence AS stated, own.score AS score,
  CASE WHEN own.licence IS NULL THEN coalesce(a.licence, b.licence) END AS inherited,
  CASE WHEN own.licence IS NULL THEN CASE WHEN a.licence IS NOT NULL THEN files.dir WHEN b.licence IS NOT NULL THEN package END END AS from_dir,
  coalesce(own.licence, a.licence, b.licence) AS in_force
FROM files LEFT JOIN own ON own.path = files.dir || '/' || name LEFT JOIN dl a ON a.dir = files.dir LEFT JOIN dl b ON b.dir = package"""

#: Calls and results of the turns; levels by a recursive walk.
TOOL_CALLS = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, CASE WHEN turn = 0 THEN NULL WHEN turn < 2 THEN 0 ELSE 2 * (turn // 2 // 2) + turn % 2 END AS dep
  FROM conversations WHERE role IN ('user', 'system')),
ok AS (SELECT c.*, EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.turn = c.dep) AS has FROM c),
lv AS (SELECT conv_id, turn, 0 AS level FROM ok WHERE dep IS NULL OR NOT has
  UNION ALL SELECT ok.conv_id, ok.turn, lv.level + 1 FROM lv JOIN ok ON ok.conv_id = lv.conv_id AND ok.dep = lv.turn AND ok.has),
r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
j AS (SELECT ok.conv_id, ok.turn, 'call_' || ok.turn AS call_id, CASE WHEN role = 'user' THEN 'ask' ELSE 'setup' END AS tool, lv.level,
    CASE WHEN role = 'user' THEN '{"first":' || (ok.turn = 0)::varchar || ',"query":' || to_json(ok.text) || ',"words":' || len(string_split(ok.text, ' ')) || '}'
      ELSE '{"prompt":' || to_json(ok.text) || '}' END AS canonical, r.text AS result, r.turn AS result_turn, (r.turn IS NOT NULL)::bigint AS n_results,
    array_to_string(list_filter([CASE WHEN ok.dep IS NOT NULL AND NOT has THEN 'dependency' END, CASE WHEN role = 'system' THEN 'missing:limit' END,
      CASE WHEN r.turn IS NULL THEN 'no_result' END], lambda x: x IS NOT NULL), ',') AS errors
  FROM ok JOIN lv ON lv.conv_id = ok.conv_id AND lv.turn = ok.turn LEFT JOIN r ON r.conv_id = ok.conv_id AND r.turn = ok.turn + 1)
SELECT *, errors = '' AS valid, CASE WHEN errors = '' THEN '{"arguments":' || canonical || ',"id":"' || call_id || '","name":"' || tool || '","result":' || to_json(result) || '}' END AS message FROM j"""


#: All 50-word windows of all texts with the smallest doc_id in which each starts.
REPEATED_WINDOWS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM w JOIN f USING (g) WHERE first < doc_id),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d)
  ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT rid, count(*) AS n FROM gone GROUP BY rid) USING (rid) LEFT JOIN kept USING (rid)"""


#: All phrases of one to four words; huge integers hold the products.
COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS MATERIALIZED (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 5) t(k) WHERE len(ws) >= k) GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND a >= 30),
t AS (SELECT lang, sum(a)::bigint AS n FROM g WHERE k = 1 GROUP BY lang),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, (2000000 * c.a::hugeint // (x.a + y.a))::bigint AS score, j
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c b ON b.lang = c.lang AND b.k > c.k AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * b.a::hugeint >= 80 * c.a::hugeint)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low ANTI JOIN held USING (lang, phrase) JOIN t USING (lang) QUALIFY rank <= 2000"""


#: crc32 of a decimal number, bit by bit: bytes are xored in, 256 stands for a shift.
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: list_concat([ord(x)::bigint], [256, 256, 256, 256, 256, 256, 256, 256])))),
    lambda a, e: CASE WHEN e < 256 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

#: All prefixes of all rebuilt conversations, and all pairs of a prefix and one above it.
PREFIX_TRIE = rf"""
WITH o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, {_CRC32} % 9 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(ts) AS m, md5(to_json(ts[1:d])::varchar) AS k, CASE WHEN d > 0 THEN md5(to_json(ts[1:d - 1])::varchar) END AS up, CASE WHEN d > 0 THEN strlen(ts[d].text) ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT d, k, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (m = d), '') AS ends FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT DISTINCT x.d AS ad, x.k AS ak, y.d AS d, y.k AS k FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.d <= y.d),
s AS (SELECT ad, ak, sum((n_convs - 1) * bytes)::bigint AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM a JOIN n USING (d, k) LEFT JOIN c USING (d, k) GROUP BY ad, ak)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.up LEFT JOIN c ON c.d = n.d AND c.k = n.k JOIN s ON s.ad = n.d AND s.ak = n.k"""
