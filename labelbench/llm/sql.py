"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SHARD_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

# a row's shard is its shortest prefix whose rows fit the limit; documents here have distinct hashes
SHARDS = rf"""
WITH rows AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
                     ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
probe AS (SELECT doc_id, n_bytes, d AS depth, h >> (60 - d) AS p FROM rows, (SELECT unnest(range(61)) AS d)),
sums AS (SELECT depth, p, sum(n_bytes) AS total FROM probe GROUP BY ALL),
fit AS (SELECT probe.doc_id, probe.n_bytes, min(CASE WHEN total <= {SHARD_BYTES} THEN depth END) AS fits
        FROM probe JOIN sums USING (depth, p) GROUP BY ALL),
leaf AS (SELECT doc_id, n_bytes, coalesce(fits, 60) AS depth, coalesce(fits, -1) AS f FROM fit)
SELECT doc_id, n_bytes, depth::INTEGER AS depth,
       substr(right(repeat('0', 60) || bin(h), 60), 1, depth) AS shard_bits, 0::BIGINT AS page
FROM leaf JOIN rows USING (doc_id, n_bytes)"""

RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS ln FROM d),
bare AS (SELECT doc_id, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM (SELECT doc_id, unnest(ln) AS x FROM w)),
jud AS (SELECT doc_id, x, len(regexp_extract_all(x, '{WORD}')) AS n,
        x <> '' AND (strpos('.!?:;…。！？"''”’»)]', right(x, 1)) = 0
          OR 10 * (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) > 3 * len(regexp_extract_all(x, '{WORD}'))
          OR 10 * (length(x) - length(replace(x, '!!', ''))) > 3 * len(regexp_extract_all(x, '{WORD}'))
          OR length(x) - length(regexp_replace(x, '[|»›>•·]', '', 'g')) >= 3
          OR regexp_matches(x, '(?i)^\W*(home|about( us)?|contact( us)?|log ?in|sign (in|up)|menu|next|previous|back to top|read more|share this)\W*$')
          OR lower(x) LIKE '%lorem ipsum%'
          OR len(list_filter(['javascript', 'cookie', 'privacy policy', 'terms of use', 'terms of service', 'subscribe', 'newsletter', 'all rights reserved',
             'your browser', 'accept all', 'click here', 'copyright'], lambda p: contains(lower(x), p))) >= 2) AS bad
        FROM bare),
lost AS (SELECT doc_id, sum(CASE WHEN bad THEN n ELSE 0 END)::BIGINT AS n_lost,
         count(CASE WHEN x <> '' THEN 1 END)::BIGINT AS lines FROM jud GROUP BY 1),
dup AS (SELECT doc_id, count(DISTINCT x) AS u FROM (SELECT doc_id, unnest(ln) AS x FROM w)
        WHERE regexp_matches(x, '{WORD}') GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT k) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM rep) GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(lines - u, 0)::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words, n_lost
      FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 10 * n_lost <= 3 * n_words AS kept FROM m"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before, lead(turn) OVER o IS NULL AS is_last,
             length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
           + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g'))
           + length('<turn >') + 1 + length('</turn>') + 1 AS n
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, coalesce(before, 'start') || '>' || role IN
             ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS ok FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars,
       bool_and(ok) AND arg_max(role, i) = 'assistant' AS valid, min(CASE WHEN NOT ok THEN i - 1 END) AS bad_turn
FROM s GROUP BY conv_id"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY 1),
wt AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM src),
run AS (SELECT *, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
               sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w, sum(source_size) OVER () AS all_size
        FROM wt WINDOW o AS (ORDER BY source_size::DOUBLE / w, r)),
ov AS (SELECT *, 2 * source_size * left_w <= w * (all_size::DOUBLE * 1.5::DOUBLE - capped::DOUBLE) AS over_cap,
              all_size::DOUBLE * 1.5::DOUBLE - capped::DOUBLE AS num FROM run),
lv AS (SELECT num AS f_num, left_w AS f_w FROM ov WHERE NOT over_cap ORDER BY source_size::DOUBLE / w, r LIMIT 1),
tg AS (SELECT source, r, source_size, CASE WHEN over_cap OR f_num IS NULL THEN (2 * source_size)::DOUBLE
              ELSE w * f_num / f_w::DOUBLE END AS target FROM ov LEFT JOIN lv ON true),
st AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.r, floor(t.target + 0.5)::BIGINT AS goal,
              (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS s
       FROM d JOIN tg t ON d.source IS NOT DISTINCT FROM t.source),
tk AS (SELECT *, greatest(0, least(size, goal - s))::BIGINT AS taken_1, greatest(0, least(size, goal - source_size - s))::BIGINT AS taken_2,
              s::DOUBLE / goal AS u1, (s + source_size)::DOUBLE / goal AS u2 FROM st),
ab AS (SELECT *, CASE r % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 0.5 END::DOUBLE AS a,
                 CASE r % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1.5 END::DOUBLE AS b FROM tk)
SELECT doc_id, size, source_size, target, taken_1 + taken_2 AS taken, taken_1, taken_2,
       CASE WHEN taken_1 > 0 THEN round(least(1.0::DOUBLE, 2.0::DOUBLE * u1 / (a + sqrt(a * a + 2.0::DOUBLE * (b - a) * u1))), 9) END AS position,
       CASE WHEN taken_2 > 0 THEN round(least(1.0::DOUBLE, 2.0::DOUBLE * u2 / (a + sqrt(a * a + 2.0::DOUBLE * (b - a) * u2))), 9) END AS position_2
FROM ab"""

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_id FROM win) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM hit),
word AS (SELECT doc_id, k, w[k] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.r = l.a),
c AS (SELECT a AS vec_id, min(r) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

# DuckDB has no crc32, so it is spelled out: bit by bit over the bytes of the id's digits
CRC32 = """
bytes AS (SELECT doc_id, i, ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT AS b FROM (SELECT doc_id, unnest(range(1, length(doc_id::VARCHAR) + 1)) AS i FROM documents)),
table8 AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n)),
crc AS (SELECT doc_id, 0 AS i, 4294967295::BIGINT AS c FROM documents
        UNION ALL SELECT crc.doc_id, crc.i + 1, xor(crc.c >> 8, t.c) FROM crc JOIN bytes b ON b.doc_id = crc.doc_id AND b.i = crc.i + 1
        JOIN table8 t ON t.n = xor(crc.c, b.b) & 255),
crc32 AS (SELECT doc_id, xor(arg_max(c, i), 4294967295) AS crc FROM crc GROUP BY 1)"""

KNESER_NEY = rf"""
WITH RECURSIVE {CRC32.strip()},
d AS (SELECT doc_id, crc % 10 = 0 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), chr(10)) AS w FROM documents JOIN crc32 USING (doc_id)),
t AS (SELECT doc_id, held_out, i, w[i] AS x, CASE WHEN i = 1 THEN chr(10) ELSE w[i - 1] END AS h FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
uni AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
tot AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM uni),
pair AS (SELECT h, x, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
lf AS (SELECT x, count(*) AS l FROM pair GROUP BY 1),
cc AS (SELECT count(CASE WHEN c = 1 THEN 1 END)::DOUBLE AS t1, count(CASE WHEN c = 2 THEN 1 END)::DOUBLE AS t2,
              count(CASE WHEN c = 3 THEN 1 END)::DOUBLE AS t3, count(CASE WHEN c = 4 THEN 1 END)::DOUBLE AS t4, count(*) AS n FROM pair),
lc AS (SELECT count(CASE WHEN l = 1 THEN 1 END)::DOUBLE AS t1, count(CASE WHEN l = 2 THEN 1 END)::DOUBLE AS t2,
              count(CASE WHEN l = 3 THEN 1 END)::DOUBLE AS t3, count(CASE WHEN l = 4 THEN 1 END)::DOUBLE AS t4, count(CASE WHEN l > 2 THEN 1 END) AS more FROM lf),
pd AS (SELECT 1 - 2 * t1 / (t1 + 2 * t2) * t2 / t1 AS d1, 2 - 3 * t1 / (t1 + 2 * t2) * t3 / t2 AS d2, 3 - 4 * t1 / (t1 + 2 * t2) * t4 / t3 AS d3, n FROM cc),
ld AS (SELECT *, (d1 * t1 + d2 * t2 + d3 * more) / n AS rest FROM (SELECT 1 - 2 * lc.t1 / (lc.t1 + 2 * lc.t2) * lc.t2 / lc.t1 AS d1,
       2 - 3 * lc.t1 / (lc.t1 + 2 * lc.t2) * lc.t3 / lc.t2 AS d2, 3 - 4 * lc.t1 / (lc.t1 + 2 * lc.t2) * lc.t4 / lc.t3 AS d3, lc.t1, lc.t2, more, pd.n FROM lc, pd)),
ctx AS (SELECT h, sum(c)::DOUBLE AS total, (any_value(d1) * count(CASE WHEN c = 1 THEN 1 END) + any_value(d2) * count(CASE WHEN c = 2 THEN 1 END)
        + any_value(d3) * count(CASE WHEN c > 2 THEN 1 END)) / sum(c) AS share FROM pair, pd GROUP BY 1),
s AS (SELECT t.doc_id, t.held_out, coalesce(uni.c, 0) AS c, coalesce(pair.c, 0) AS pc, ctx.total, ctx.share, coalesce(lf.l, 0) AS l
      FROM t LEFT JOIN uni USING (x) LEFT JOIN pair USING (h, x) LEFT JOIN ctx USING (h) LEFT JOIN lf USING (x)),
p AS (SELECT s.*, tot.n, tot.v, (l - CASE WHEN l = 0 THEN 0 WHEN l = 1 THEN ld.d1 WHEN l = 2 THEN ld.d2 ELSE ld.d3 END) / ld.n + ld.rest / (tot.v + 1) AS low,
      pc - CASE WHEN pc = 0 THEN 0 WHEN pc = 1 THEN pd.d1 WHEN pc = 2 THEN pd.d2 ELSE pd.d3 END AS lower_pc FROM s, tot, pd, ld),
o AS (SELECT doc_id, held_out, count(*) AS n_tokens, count(CASE WHEN c > 0 THEN 1 END) AS n_known, any_value(n) AS train_tokens,
      fsum(log10((c + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score,
      fsum(log10(CASE WHEN total IS NULL THEN low ELSE lower_pc / total + share * low END)) AS score FROM p GROUP BY ALL)
SELECT *, 10 ** (-score / n_tokens) AS perplexity FROM o"""

TRIE = rf"""
WITH RECURSIVE convs AS (SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE conv_id IS NOT NULL), {CRC32.strip().replace("FROM documents", "FROM convs")},
t AS (SELECT conv_id, x, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(x)) AS k
      FROM (SELECT conv_id, turn, length(coalesce(role, '')) || ' ' || coalesce(role, '') || ' ' || coalesce(text, '') AS x,
                   length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT doc_id AS conv_id, crc % 6 AS h FROM crc32),
r AS (SELECT h.conv_id, 0 AS part, k, x, n FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND k <= h
      UNION ALL SELECT h.conv_id, 1, k, x, n FROM h JOIN t USING (conv_id) WHERE k > h),
l AS (SELECT doc_id AS conv_id, coalesce(xs, []) AS xs, coalesce(ns, []) AS ns FROM convs LEFT JOIN
      (SELECT conv_id, list(md5(x) ORDER BY part, k) AS xs, list(n ORDER BY part, k) AS ns FROM r GROUP BY 1) g ON g.conv_id = doc_id),
p AS (SELECT conv_id, d, array_to_string(xs[1:d], '') AS k, coalesce(ns[d], 0) AS n, len(xs) = d AS ends FROM (SELECT *, unnest(range(len(xs) + 1)) AS d FROM l)),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
                sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY ALL),
ch AS (SELECT d - 1 AS d, left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
sub AS (SELECT a AS d, left(k, 32 * a) AS k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
        FROM (SELECT k, (n_children IS NULL)::INT AS leaf, (n_convs - 1) * n AS saved, unnest(range(d + 1)) AS a FROM node LEFT JOIN ch USING (d, k)) GROUP BY ALL)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN sub USING (d, k) LEFT JOIN ch USING (d, k) LEFT JOIN node up ON up.d = node.d - 1 AND up.k = left(node.k, 32 * (node.d - 1))"""
