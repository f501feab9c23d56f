"""DuckDB SQL for the queries that SQL can express."""

#: Words of a text: what is left between runs of 0x20 and 0x09-0x0D.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
earliest AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT win.doc_id, j FROM win JOIN earliest USING (s), unnest(range(i, i + 13)) AS t(j) WHERE m < win.doc_id),
word AS (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM d, unnest(range(1, len(w) - 1)) AS t(i)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_one AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_one ON least_one.a = d.doc_id
"""

_RENDER = "array_to_string(list_transform({0}, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), '')"
_SPANS = """coalesce(array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'), lambda i:
  CAST(CAST(coalesce(list_sum(list_transform({0}[1:i-1], lambda t: 24 + length(coalesce(t.role, '')) + length(coalesce(t.text, '')))), 0) + 13 + length({0}[i].role) AS BIGINT) AS VARCHAR) || '-' ||
  CAST(CAST(coalesce(list_sum(list_transform({0}[1:i-1], lambda t: 24 + length(coalesce(t.role, '')) + length(coalesce(t.text, '')))), 0) + 13 + length({0}[i].role) + length(coalesce({0}[i].text, '')) + 10 AS BIGINT) AS VARCHAR)), ','), '')"""

_OP4 = f"""
WITH g AS (
  SELECT conv_id // 2 AS pair_id,
    coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (conv_id % 2 = 0), []) AS a,
    coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (conv_id % 2 = 1), []) AS b
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
p AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, least(len(a), len(b))) AS n FROM g),
s AS (SELECT pair_id, n, a[1:n] AS shared, a[n+1:] AS c, b[n+1:] AS r FROM p)
SELECT pair_id, {_RENDER.format('shared')} AS prompt, {_RENDER.format('c')} AS chosen, {_RENDER.format('r')} AS rejected,
  {_SPANS.format('c')} AS chosen_mask, {_SPANS.format('r')} AS rejected_mask, CAST(n AS BIGINT) AS prompt_turns,
  CAST(len(c) AS BIGINT) AS chosen_turns, CAST(len(r) AS BIGINT) AS rejected_turns, len(c) = 0 AND len(r) = 0 AS identical
FROM s
"""

#: Base32 of the SHA-1: its hex digits as bits, five at a time.
_BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda h: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', h)]), '')"

_OP1 = f"""
WITH p AS (SELECT page_id, octet_length(CAST(encode(coalesce(html, '')) AS BLOB)) AS payload_bytes, {_BITS} AS bits FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * CAST(bits[5*i+1] AS INT) + 8 * CAST(bits[5*i+2] AS INT) + 4 * CAST(bits[5*i+3] AS INT) + 2 * CAST(bits[5*i+4] AS INT) + CAST(bits[5*i+5] AS INT), 1)), '') AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS largest FROM d GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM d JOIN m USING (payload_digest)
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t"

_OP12 = f"""
WITH word AS (SELECT doc_id, {_TERMS} FROM documents),
ask AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
long AS (SELECT doc_id, count(*) AS n FROM word GROUP BY 1),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM long),
post AS (SELECT doc_id, t, count(*) AS tf FROM word WHERE t IN (SELECT t FROM ask) GROUP BY ALL),
term AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, whole GROUP BY t, big_n),
part AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))) AS u FROM post JOIN term USING (t) JOIN long USING (doc_id), whole),
score AS (SELECT item_id, doc_id, CAST(sum(times * u) AS BIGINT) AS score FROM ask JOIN part USING (t) GROUP BY ALL HAVING sum(times * u) > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""

#: CRC-32 of the decimal doc_id, a byte and then a bit at a time.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda r, b: list_reduce(list_concat([xor(r, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_OP13 = f"""
WITH c AS (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents),
c2 AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
c3 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM c2),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i+1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM c3),
word AS (SELECT doc_id, n, i - 1 AS i, w[i] AS x FROM d, unnest(range(1, n + 1)) AS t(i)),
same AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
part AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS k FROM part GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, k, min(q) AS q FROM stretch GROUP BY doc_id, s, k),
lost AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(s + q, s + k)) AS t(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || k || ',' || q || chr(10), '' ORDER BY s, q) AS lines, min(ROW(-k, s, q)) AS top FROM run GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top[2] AS BIGINT) AS start, CAST(-top[1] AS BIGINT) AS length, CAST(top[3] AS BIGINT) AS period,
  CAST(1000 * -top[1] // top[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {
    "op1_warc_zstd": _OP1,
    "op4_preference_pairs": _OP4,
    "op3_substring_dedup": _OP3,
    "op10_near_duplicates": _OP10,
    "op11_bloom_exact_dedup": _OP11,
    "op12_tput_search": _OP12,
    "op13_periodic_runs": _OP13,
}
