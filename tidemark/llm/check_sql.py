"""Check SQL of the text operators, for DuckDB on the same tables."""

_BLANK = r"[\x20\x09-\x0D]+"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_BLANK}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(other) AS component_id, w.doc_id = min(other) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id)
GROUP BY w.doc_id, n.n
"""

QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS host,
    coalesce(text, '') AS text, {_WORDS} AS words
  FROM documents),
windows AS (
  SELECT rid, i, words[i:i + 2] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM again CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY rid),
lines AS (
  SELECT rid, host, text, line, trim(regexp_replace(lower(line), '[0-9]+', '0', 'g'), e' \t\n\x0b\x0c\r') AS normal
  FROM (SELECT rid, host, text, unnest(string_split(text, e'\n')) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
held AS (SELECT host, normal, count(DISTINCT text) AS c FROM lines GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
frequent AS (
  SELECT host, normal FROM held JOIN hosts USING (host) WHERE c > 8 AND c > docs * 0.10),
lost AS (
  SELECT rid, sum(len(regexp_extract_all(normal, '[^\x20\x09-\x0D]+'))) AS lost_words
  FROM lines JOIN frequent USING (host, normal) GROUP BY rid),
f AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN repeated USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 50 * n_words AS kept
FROM f
"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

# Five hexadecimal digits make four letters.
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, payload, sha1(payload) AS hex FROM p),
v AS (SELECT page_id, payload, list_transform(range(8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::INTEGER) AS v FROM h),
b AS (
  SELECT page_id, payload, array_to_string(list_transform(v, lambda x: concat(
    substr({_BASE32}, (x >> 15) % 32 + 1, 1), substr({_BASE32}, (x >> 10) % 32 + 1, 1),
    substr({_BASE32}, (x >> 5) % 32 + 1, 1), substr({_BASE32}, x % 32 + 1, 1))), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY payload) AS first_id
  FROM v)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""
