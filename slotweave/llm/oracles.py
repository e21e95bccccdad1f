"""SQL of the queries that SQL can express."""

MIXTURE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rnk
  FROM d GROUP BY source
), c AS (SELECT *, 3 * source_size AS cap, 1 + rnk % 3 AS weight FROM s
), o AS (
  SELECT *, row_number() OVER w AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights
  FROM c WINDOW w AS (ORDER BY cap * 6 / weight, rnk)
), l AS (SELECT place AS level_at, rest AS level_rest, weights AS level_weights FROM o WHERE rest * weight <= cap * weights ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size, rnk,
         CASE WHEN place >= level_at THEN CAST(level_rest * weight AS DOUBLE) / CAST(level_weights AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
  FROM o LEFT JOIN l ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY t.rnk ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN (start_at + size / 2.0 <= target)::INT + (start_at + source_size + size / 2.0 <= target)::INT
                 + (start_at + 2 * source_size + size / 2.0 <= target)::INT ELSE 0 END AS BIGINT) AS copies,
         CASE rnk % 3 WHEN 0 THEN [0.0::DOUBLE, 4.0, 7.0, 9.0, 10.0] WHEN 1 THEN [0.0::DOUBLE, 1.0, 2.0, 3.0, 4.0] ELSE [0.0::DOUBLE, 1.0, 3.0, 6.0, 10.0] END AS run
  FROM p
), u AS (SELECT *, least(CASE WHEN target > 0 THEN CAST(start_at AS DOUBLE) / target END, 1.0) * run[5] AS used FROM k
), f AS (SELECT *, least(len(list_filter(run, lambda x: x <= used)) - 1, 3) AS phase FROM u)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken,
       CASE WHEN copies > 0 THEN CAST(phase * 1000000 + floor((used - run[phase + 1]) / (run[phase + 2] - run[phase + 1]) * 1000000.0) AS BIGINT) END AS position
FROM f
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), w AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first_id,
         list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: CAST('0x' || substr(hex, i * 5 + 1, 5) AS BIGINT)) AS parts
  FROM p
), b AS (
  SELECT *, list_transform(parts, lambda v: list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> k) & 31) + 1 AS BIGINT), 1))) AS chars
  FROM w
)
SELECT page_id, payload_bytes, array_to_string(flatten(chars), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

TOP_K = r"""
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT q.row_id, q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v x ON x.row_id <> q.row_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY row_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), c AS (SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(r.other)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY 1)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), phrases AS MATERIALIZED (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100 OR size = 1
), totals AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM phrases WHERE size = 1 GROUP BY 1
), candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1
), inside AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(i + 1, size + 1)) AS j FROM (SELECT *, unnest(range(1, size)) AS i FROM candidates)) WHERE j - i + 1 < size GROUP BY ALL
), kept AS (SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, true)
), cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ') JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM scored QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""

#: The first table is that of CRC-32, by its polynomial; features are hashed byte by byte.
RESAMPLING = r"""
WITH tab AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, text, 0 AS corpus FROM documents UNION ALL SELECT NULL, NULL, text, 1 FROM benchmark
), words AS (
  SELECT row_id, doc_id, corpus, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), runs AS (
  SELECT row_id, corpus, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words
), counts AS MATERIALIZED (SELECT row_id, corpus, f, count(*) AS c FROM runs GROUP BY ALL
), hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counts)
), buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM hexes, tab
), sums AS (
  SELECT bucket, CAST(coalesce(sum(c) FILTER (corpus = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(c) FILTER (corpus = 1), 0) AS DOUBLE) AS t FROM counts JOIN buckets USING (f) GROUP BY 1
), gains AS (
  SELECT bucket, CAST(floor(1000.0 * ln(((t + 1.0) * (sum(s) OVER () + 10000.0)) / ((s + 1.0) * (sum(t) OVER () + 10000.0)))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT row_id, CAST(sum(c * gain) AS BIGINT) AS weight, CAST(sum(c) AS BIGINT) AS n_features FROM counts JOIN buckets USING (f) JOIN gains USING (bucket) WHERE corpus = 0 GROUP BY 1
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (row_id) WHERE corpus = 0
), placed AS (
  SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
