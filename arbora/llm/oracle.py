"""DuckDB SQL of the operators that need more than a few lines of it."""

# CRC-32 byte by byte over the distinct n-grams, by its table.
RESAMPLE_SQL = r"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
texts AS (
  SELECT doc_id AS id, text, true AS doc FROM documents UNION ALL SELECT item_id, text, false FROM benchmark
), words AS (
  SELECT row_number() OVER () AS r, id, doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), grams AS (
  SELECT r, unnest(w) AS g FROM words
  UNION ALL SELECT r, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM words
  UNION ALL SELECT r, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda p: p[1] || ' ' || p[2] || ' ' || p[3])) FROM words
), counted AS (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g),
once AS (SELECT g, hex(encode(g)) AS h, strlen(g) AS size FROM (SELECT DISTINCT g FROM counted)),
steps(g, h, size, pos, c) AS (
  SELECT g, h, size, 0, 4294967295 FROM once
  UNION ALL
  SELECT g, h, size, pos + 1, xor(c >> 8, t[(xor(c, CAST('0x' || substr(h, 2 * pos + 1, 2) AS BIGINT)) & 255) + 1]) FROM steps, tab WHERE pos < size
), hashed AS (SELECT g, xor(c, 4294967295) % 10000 AS bucket FROM steps WHERE pos = size),
filled AS (
  SELECT r, doc, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (g) JOIN words USING (r) GROUP BY ALL
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (doc), 0) AS s, coalesce(sum(n) FILTER (NOT doc), 0) AS t FROM filled GROUP BY bucket
), every AS (SELECT sum(s) AS s, sum(t) AS t FROM totals),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(totals.t + 1 AS DOUBLE) * CAST(every.s + 10000 AS DOUBLE)
         / (CAST(totals.s + 1 AS DOUBLE) * CAST(every.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM totals, every
), weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM filled JOIN gains USING (bucket) WHERE doc GROUP BY r),
scored AS (
  SELECT r, id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE doc
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE words >= 20
)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= 5 * n // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

# Flags per document, then every order of the filters by recursion over what is left.
AUDIT_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), first AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
told AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), words AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
  FROM words JOIN first USING (text) LEFT JOIN told USING (doc_id)
), counted AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT f AS o FROM letters
  UNION ALL SELECT o || f FROM orders, letters WHERE NOT contains(o, f)
), steps AS (SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before
  FROM orders, range(1, 6) r(s) WHERE length(o) = 5
), cases AS (
  SELECT part, filter_order, step, f, n, good, toxic, failed = f AS sole, contains(failed, f) AS fails,
         length(translate(failed, before, '')) < length(failed) AS earlier
  FROM counted, steps
), sums AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS toxic_lost
  FROM cases GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM sums
"""
