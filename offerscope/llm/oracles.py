"""DuckDB SQL for the operators that SQL can express.

Not here: op3, op6 and op13 (trained models), op4 (a tokenizer), op8 (guess costs) and the pipeline; tests
hold these against brute force, exact round trips and held-out labels.
"""

from offerscope.llm import quality_rules

_W = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 11, 1))) AS u(p)),
least AS (SELECT x, min(doc_id) AS f FROM win GROUP BY x),
hit AS (SELECT win.doc_id, win.p FROM win JOIN least USING (x) WHERE least.f < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hit, unnest(range(0, 13)) AS u(k)),
word AS (SELECT doc_id, i AS p, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT word.doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY word.p) AS k FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

# The hash tree level by level (regions of 10 shards, racks of 5, the 41st shard alone in a fifth region); crc32 by its table.
_DRAW = "-ln((('0x' || substr(md5(doc_id || '/{kind}' || n), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)"
OP2 = rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
raw AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
sums AS (SELECT doc_id, n + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32 FROM raw, crc),
grown AS (SELECT unnest([false, true]) AS g),
region AS (SELECT doc_id, g, arg_min(n, {_DRAW.format(kind="region")} / CASE WHEN n = 4 THEN 1 ELSE 10 END) AS region FROM documents, grown, range(5) AS r(n) WHERE g OR n < 4 GROUP BY doc_id, g),
rack AS (SELECT doc_id, g, arg_min(n, {_DRAW.format(kind="rack")} / CASE WHEN n = 8 THEN 1 ELSE 5 END) AS rack FROM region, range(9) AS r(n) WHERE n // 2 = region GROUP BY doc_id, g),
leaf AS (SELECT doc_id, g, arg_min(n, {_DRAW.format(kind="shard")}) AS leaf FROM rack, range(41) AS r(n) WHERE n // 5 = rack GROUP BY doc_id, g),
won AS (SELECT doc_id, max(leaf) FILTER (NOT g)::INT AS shard, max(leaf) FILTER (g)::INT AS grown_shard FROM leaf GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id || '/' || text_crc32), 1, 3))::BIGINT // 4, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM sums JOIN won USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages), q AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha256(raw) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM q LEFT JOIN f ON f.payload_digest = q.payload_digest
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') || ' ' || len(w) ELSE array_to_string(w[p:p + 3], ' ') END AS x FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, link.b FROM reach r JOIN link ON link.a = r.o)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
q AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM benchmark),
a AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS u(p)),
b AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS x FROM q, unnest(range(1, greatest(len(w) - 3, 1))) AS u(p)),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id), c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM a JOIN b USING (x) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

_B = quality_rules.BASE | quality_rules.POLICIES[quality_rules.CURRENT]
OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
v AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS u(p)),
twice AS (SELECT doc_id, unnest(list(p)) AS p FROM v GROUP BY doc_id, x HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM twice, unnest(range(0, 8)) AS u(k) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d), full_line AS (SELECT doc_id, l, count(*) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines, sum(n)::BIGINT AS n_lines FROM full_line GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) AS n_runs FROM d, unnest(range(2, len(w) + 1)) AS u(i) WHERE w[i] = w[i - 1] GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_runs, 0) AS n_runs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, length(t) - length(replace(t, '|', '')) AS n_bars
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN runs USING (doc_id)),
b AS (SELECT *, (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT + 16 * (10 * n_dup_lines > 3 * n_lines)::INT
  + 32 * (10 * n_runs > 3 * n_words)::INT + 64 * (2 * n_upper > n_letters)::INT + 128 * (5 * n_bars > n_words AND n_lines >= 3)::INT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits::BIGINT AS failed_bits, failed_bits & {quality_rules.BASE} <> 0 AS base_failed, failed_bits & {_B} = 0 AS kept FROM b
"""

_M = quality_rules.POLICIES[quality_rules.CURRENT]
_RULES = ", ".join(f"('{name}', {1 << b})" for name, b in quality_rules.RULES.items() if _M >> b & 1)
ABLATIONS = f"""
WITH f AS (SELECT failed_bits & {_M} AS own FROM ({OP10})), r(rule, bit) AS (VALUES {_RULES})
SELECT rule, count(*) FILTER (own & bit <> 0) AS n_failed, count(*) FILTER (own = bit) AS n_only, count(*) FILTER (own & ~bit = 0) AS n_kept_without FROM r, f GROUP BY rule
"""

_F = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _F + "')"
OP11 = rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT doc_id, {_LOW} AS w FROM documents), b AS (SELECT {_LOW} AS w FROM benchmark),
raw AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL), aim AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM b) GROUP BY x),
word AS (SELECT x, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS k FROM (SELECT x FROM raw UNION SELECT x FROM aim), crc),
s AS (SELECT k, sum(c)::BIGINT AS s FROM raw JOIN word USING (x) GROUP BY k), t AS (SELECT k, sum(c)::BIGINT AS t FROM aim JOIN word USING (x) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM range(10000) AS r(k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
own AS (SELECT doc_id, sum(c * gain)::BIGINT AS weight FROM raw JOIN word USING (x) JOIN gain USING (k) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN own USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (10 * (SELECT count(*) FROM ranked)) // 100 THEN r END AS rank, n_features AS n_words FROM scored LEFT JOIN ranked USING (doc_id)
"""

# A run of period q holds a stretch of places whose three words equal those q later; stretches are islands of places of one q.
OP12 = rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) AS h FROM documents, crc),
g AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM h), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w FROM p),
gram AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 3], ' ') AS x FROM d, unnest(range(0, greatest(n - 2, 0))) AS u(i)),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS m FROM island GROUP BY doc_id, q, k HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, m, min(q) AS q FROM stretch GROUP BY ALL), gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(s + q, s + m)) AS u(i)),
word AS (SELECT doc_id, i, w[i + 1] AS x FROM d, unnest(range(0, n)) AS u(i)), kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS l, min((-m, s, q)) AS top FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[2]::BIGINT AS start, -top[1]::BIGINT AS length, top[3]::BIGINT AS period, (-1000 * top[1]) // top[3] AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM d LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op2_hash_tree_sharding": OP2,
    "op5_zstd_warc": OP5,
    "op7_ngram_jaccard_join": OP7,
    "op9_benchmark_decontamination": OP9,
    "op10_quality_rules": OP10,
    "op11_crc_resampling": OP11,
    "op12_recompression_runs": OP12,
    "quality_rule_ablations": ABLATIONS,
}
