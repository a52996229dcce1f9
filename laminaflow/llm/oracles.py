"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    # every window of 50 bytes as hexadecimal text, its smallest document, and the runs of windows that come later
    "op1_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM d, unnest(range(0, n - 49)) t(k)),
hit AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS f FROM w) WHERE f < doc_id),
isl AS (SELECT doc_id, k, sum(nw) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (SELECT doc_id, k, CASE WHEN k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 1 ELSE 0 END AS nw FROM hit)),
run AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM isl GROUP BY doc_id, g),
part AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM run),
cut AS (SELECT part.doc_id, CAST(sum(b - a) AS BIGINT) AS r, count(*) AS c, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || any_value(substr(h, 2 * z + 1)) AS kept
  FROM part JOIN d USING (doc_id) JOIN (SELECT doc_id, max(b) AS z FROM run GROUP BY 1) USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)""",
    "op3_ngram_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 4) AS g FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) t(k)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) USING (doc_id)""",
    # base 32 of the digest: four characters from every five hexadecimal ones
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM r""",
    "op10_positional_index": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, k, k + 9) AS g FROM i, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) t(k)),
size AS (SELECT DISTINCT len(g) AS n FROM win),
place AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS g FROM d, size, unnest(range(1, len(w) - n + 2)) t(k)),
hit AS (SELECT doc_id, k, n, item_id FROM place JOIN win USING (g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) t(p) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op11_line_bitmaps": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, pos, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    # dp holds, per conversation and number of rows read, the least (cost, audit) that leads to each end of the roles
    "op12_turn_repair": """WITH RECURSIVE bits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS b FROM conversations),
crc(n, i, poly) AS (SELECT n, 0, CAST(n AS UBIGINT) FROM range(256) t(n)
  UNION ALL SELECT n, i + 1, CASE WHEN poly % 2 = 1 THEN xor(poly // 2, CAST(3988292384 AS UBIGINT)) ELSE poly // 2 END FROM crc WHERE i < 8),
tab AS (SELECT list(poly ORDER BY n) AS t FROM crc WHERE i = 8),
lot AS (SELECT bits.* EXCLUDE (b), xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], [CAST('0x' || substr(hex(b), CAST(2 * g + 1 AS BIGINT), 2) AS UBIGINT) FOR g IN range(octet_length(b))]),
  lambda c, v: xor(c // 256, t[CAST(xor(c % 256, v) + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) % 20 AS d FROM bits, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS c FROM lot),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), c) AS n FROM damaged),
bare AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM placed),
fault AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN substr(body, -1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM bare),
ins AS (SELECT * FROM (VALUES ('', '', 0, '', ''), ('', 'u', 2, 'I', 'u'), ('', 'a', 4, 'II', 'ua'), ('s', 's', 0, '', ''), ('s', 'u', 2, 'I', 'u'), ('s', 'a', 4, 'II', 'ua'), ('u', 'u', 0, '', ''), ('u', 'a', 2, 'I', 'a'),
  ('a', 'a', 0, '', ''), ('a', 'u', 2, 'I', 'u')) t(p, q, cost, l, r)),
act AS (SELECT * FROM (VALUES ('D', '', ''), ('D', 's', 's'), ('D', 'u', 'u'), ('D', 'a', 'a'), ('K', '', 's'), ('K', '', 'u'), ('K', 's', 'u'), ('K', 'u', 'a'), ('K', 'a', 'u'), ('R', '', 'u'), ('R', 's', 'u'), ('R', 'u', 'a'), ('R', 'a', 'u')) t(e, q, z)),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, '' AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, n, q, w.cost, w.audit, w.lines FROM (SELECT dp.conv_id, fault.n, act.z AS q, min({'cost': dp.cost + ins.cost + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND f = 't' THEN 1 ELSE 0 END,
    'audit': dp.audit || ins.l || e, 'lines': dp.lines || [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END FOR x IN string_split(ins.r, '') IF x <> ''] || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
      ELSE [CASE act.z WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END}) AS w
    FROM dp JOIN fault ON fault.conv_id IS NOT DISTINCT FROM dp.conv_id AND fault.n = dp.n + 1 JOIN ins ON ins.p = dp.q JOIN act ON act.q = ins.q
    WHERE (e <> 'K' OR ini = act.z) AND (e = 'D' OR f NOT IN ('b', 'd')) GROUP BY dp.conv_id, fault.n, act.z)),
last AS (SELECT conv_id, max(n) AS n FROM dp GROUP BY conv_id),
done AS (SELECT dp.conv_id, min({'cost': dp.cost + ins.cost, 'audit': dp.audit || ins.l, 'lines': dp.lines || [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END FOR x IN string_split(ins.r, '') IF x <> '']}) AS w
  FROM dp JOIN last ON last.conv_id IS NOT DISTINCT FROM dp.conv_id AND last.n = dp.n JOIN ins ON ins.p = dp.q WHERE ins.q IN ('', 'a') GROUP BY dp.conv_id),
pair AS (SELECT conv_id, ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM fault),
num AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated FROM fault GROUP BY conv_id),
bad AS (SELECT conv_id, count(*) FILTER (p NOT IN ('su', 'ua', 'au')) AS illegal FROM pair GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.cost AS cost, w.audit AS audit,
  sha256(array_to_string(w.lines, chr(10))) AS repaired_sha256 FROM done LEFT JOIN num ON num.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM done.conv_id""",
}
