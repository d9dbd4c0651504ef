"""DuckDB SQL for the queries whose results SQL can express."""

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Least draw of each shard's leaf; with equal leaves the tree's descent ends at the least leaf of all.
OP3 = """WITH k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') key FROM documents),
draws AS (SELECT DISTINCT key, s, CAST('0x' || substr(md5(key || '/' || s), 1, 12) AS BIGINT) u FROM k, range(17) r(s)),
pick AS (SELECT key, arg_max(s, u) FILTER (WHERE s < 16) shard, arg_max(s, u) grown FROM draws GROUP BY 1),
tab AS (SELECT list(c ORDER BY i) t FROM (WITH RECURSIVE step(i, c, b) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL
 SELECT i, CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END, b + 1 FROM step WHERE b < 8) SELECT i, c FROM step WHERE b = 8)),
raw AS (SELECT k.*, hex(encode(coalesce(text, ''))) h FROM k),
crc AS (SELECT raw.*, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
 lambda a, b: xor(t[CAST(xor(a, b) % 256 AS INT) + 1], a // 256), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) text_crc32 FROM raw, tab)
SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
 row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(key || '/' || (length(h) // 2 + 1) || '/' || text_crc32), 1, 8) AS BIGINT) % 1024, doc_id, length(h), text_crc32) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM crc JOIN pick USING (key)"""

OP4 = f"""WITH d AS (SELECT row_number() OVER () rid, doc_id, {_WORDS.format("text")} w FROM documents),
win AS (SELECT rid, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) p FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
first AS (SELECT h, min(doc_id) f FROM win GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) i FROM win JOIN first USING (h) WHERE doc_id > f),
listed AS (SELECT rid, list(i) g FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_filter(w, lambda x, i: g IS NULL OR NOT list_contains(g, i)), ' ')) AS kept_sha256 FROM d LEFT JOIN listed USING (rid)"""

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') html, sha1(coalesce(html, '')) s FROM pages),
f AS (SELECT s, max(page_id) first FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 AS INT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (s)"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' .'] ELSE [] END) s FROM d),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
ranked AS (SELECT doc_id, sh.s, n.n, row_number() OVER (PARTITION BY doc_id ORDER BY df, sh.s) r FROM sh JOIN n USING (doc_id) JOIN (SELECT s, count(*) df FROM sh GROUP BY 1) c ON c.s = sh.s),
pre AS (SELECT doc_id, s, n FROM ranked WHERE r <= n - (85 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id x, b.doc_id y, a.n nx, b.n ny FROM pre a JOIN pre b ON a.s = b.s AND a.doc_id > b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (SELECT x, y FROM (SELECT x, y, nx, ny, count(*) c FROM cand JOIN sh a ON a.doc_id = x JOIN sh b ON b.doc_id = y AND b.s = a.s GROUP BY 1, 2, 3, 4) WHERE 100 * c >= 85 * (nx + ny - c)),
both_ AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT DISTINCT x, x FROM both_ UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON both_.x = reach.y),
comp AS (SELECT x doc_id, min(y) c FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(coalesce(c, doc_id) = doc_id, true) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""

OP11 = rf"""WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) s FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, s, string_split(s, ' ') v, CAST(count(*) AS HUGEINT) f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT f.*, unnest(range(1, k)) j FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.k, c.s, c.f a, c.j, x.f l, y.f r, 1000 * c.f * n // (x.f * y.f) score, n FROM c JOIN n USING (lang)
 JOIN f x ON x.lang = c.lang AND x.s = array_to_string(c.v[:c.j], ' ') JOIN f y ON y.lang = c.lang AND y.s = array_to_string(c.v[c.j + 1:], ' ')),
whole AS (SELECT DISTINCT i.lang, i.s FROM f i JOIN f o ON i.lang = o.lang AND o.k > i.k AND o.f >= i.f AND contains(' ' || o.s || ' ', ' ' || i.s || ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, s ORDER BY score, j) nth FROM cut),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank FROM best LEFT JOIN whole USING (lang, s) WHERE nth = 1 AND whole.s IS NULL)
SELECT lang, rank, s AS phrase, CAST(a AS BIGINT) a, CAST(l AS BIGINT) l, CAST(r AS BIGINT) r, CAST(n AS BIGINT) n, CAST(score AS BIGINT) score FROM ranked WHERE rank <= 2000"""

#: CRC-32 by table, as in OP3, and a recursion over turns that keeps the least (cost, letters, turns) of each state.
OP13 = r"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) t FROM (WITH RECURSIVE step(i, c, b) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL
 SELECT i, CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END, b + 1 FROM step WHERE b < 8) SELECT i, c FROM step WHERE b = 8)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) h FROM conversations),
crc AS (SELECT raw.*, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
 lambda a, b: xor(t[CAST(xor(a, b) % 256 AS INT) + 1], a // 256), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 d FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE r END r, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END x, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) FROM crc WHERE d <> 0),
ord AS (SELECT conv_id, turn, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) i FROM dam),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) nth,
 rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) y, substr(r, 1, 1) c FROM ord),
f AS (SELECT *, CASE WHEN y = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(y, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END fault, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c pair FROM num),
sums AS (SELECT conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (fault = 'b') blank, count(*) FILTER (fault = 'd') duplicate, count(*) FILTER (fault = 't') truncated,
 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal FROM f GROUP BY 1),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) i, {'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} s0, {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} s1,
 {'c': CAST(2 AS BIGINT), 'a': 'I', 't': ['user:']} s2, {'c': CAST(4 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']} s3 FROM sums
UNION ALL SELECT conv_id, i, b0, b1, n2, list_sort([b3, {'c': n2.c + 2, 'a': n2.a || 'I', 't': list_append(n2.t, 'assistant:')}])[1] FROM (
SELECT *, list_sort([b2, {'c': b0.c + 2, 'a': b0.a || 'I', 't': list_append(b0.t, 'user:')}, {'c': b1.c + 2, 'a': b1.a || 'I', 't': list_append(b1.t, 'user:')}, {'c': b3.c + 2, 'a': b3.a || 'I', 't': list_append(b3.t, 'user:')}])[1] n2 FROM (
SELECT conv_id, i, {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t} b0,
 list_sort([{'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + CASE WHEN keep AND c = 's' THEN z ELSE 1000000000 END, 'a': s0.a || 'K', 't': list_append(s0.t, v)}])[1] b1,
 list_sort([{'c': s2.c + 3, 'a': s2.a || 'D', 't': s2.t}, {'c': s0.c + uc, 'a': s0.a || ul, 't': list_append(s0.t, uv)}, {'c': s1.c + uc, 'a': s1.a || ul, 't': list_append(s1.t, uv)}, {'c': s3.c + uc, 'a': s3.a || ul, 't': list_append(s3.t, uv)}])[1] b2,
 list_sort([{'c': s3.c + 3, 'a': s3.a || 'D', 't': s3.t}, {'c': s2.c + CASE WHEN NOT keep THEN 1000000000 WHEN c = 'a' THEN z ELSE z + 2 END, 'a': s2.a || CASE WHEN c = 'a' THEN 'K' ELSE 'R' END, 't': list_append(s2.t, CASE WHEN c = 'a' THEN v ELSE 'assistant:' || x END)}])[1] b3
FROM (SELECT dp.*, f.i AS j, f.x, f.c, fault NOT IN ('b', 'd') keep, CASE WHEN fault = 't' THEN 1 ELSE 0 END z, r || ':' || x v, CASE WHEN fault IN ('b', 'd') THEN 1000000000 WHEN c = 'u' THEN z ELSE z + 2 END uc, CASE WHEN c = 'u' THEN 'K' ELSE 'R' END ul,
 CASE WHEN c = 'u' THEN v ELSE 'user:' || x END uv FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1) p(conv_id, i0, s0, s1, s2, s3, i, x, c, keep, z, v, uc, ul, uv)))),
best AS (SELECT sums.*, list_sort([s0, s3])[1] b FROM dp JOIN sums ON dp.conv_id IS NOT DISTINCT FROM sums.conv_id AND dp.i = n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
 sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id"""

ORACLE_SQL: dict[str, str] = {"op3_sharding": OP3, "op4_substring_dedup": OP4, "op5_warc": OP5, "op9_near_duplicates": OP9, "op11_collocations": OP11, "op13_conversation_repair": OP13}
