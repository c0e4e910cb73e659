"""DuckDB SQL of those queries that SQL can express."""

ORACLE_SQL = {
    "op5_near_texts": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 85 * (x.n + y.n - common)
), components(id, least) USING KEY (id) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT b, min(c.least) FROM components c JOIN links ON c.id = a JOIN recurring.components r ON r.id = b
    GROUP BY b HAVING min(c.least) < min(r.least)
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least AS component_id, doc_id = least AS kept
FROM documents JOIN components ON id = doc_id LEFT JOIN sizes USING (doc_id)
""",
    "op7_top_k": r"""
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op8_repeats": r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS data FROM documents
), sized AS (
    SELECT *, octet_length(data) AS n_bytes FROM texts
), windows AS (
    SELECT r, place, md5(array_slice(data, place + 1, place + 200)) AS name
    FROM (SELECT r, data, unnest(range(n_bytes - 199)) AS place FROM sized)
), repeated AS (
    SELECT r, place FROM windows SEMI JOIN (SELECT name FROM windows GROUP BY name HAVING count(*) > 1) USING (name)
), stepped AS (
    SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY r ORDER BY place) + 200 THEN 0 ELSE 1 END AS fresh FROM repeated
), runs AS (
    SELECT r, min(place) AS low, max(place) + 200 AS high
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY place) AS run FROM stepped) GROUP BY r, run
), removed AS (
    SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
), gaps AS (  -- what stands before each run, and after the last
    SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS low, low AS high FROM runs
    UNION ALL SELECT r, coalesce(max(high), 0), any_value(n_bytes) FROM sized LEFT JOIN runs USING (r) GROUP BY r
), kept AS (
    SELECT r, string_agg(hex(array_slice(data, low + 1, high)), '' ORDER BY low) AS digits
    FROM gaps JOIN sized USING (r) WHERE low < high GROUP BY r
)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(digits, ''))) AS kept_sha256
FROM sized LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
""",
    "op9_url_filter": r"""
WITH split AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*', 0),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM split
), judged AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/')
            THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/')
            THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
        END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM judged
""",
    "op10_near_vectors": r"""
WITH RECURSIVE whole AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), unit AS (
    SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS length FROM whole
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b
    FROM unit x JOIN unit y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE x.length > 0 AND y.length > 0
      AND list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) / (x.length * y.length) >= 0.98
), components(id, least) USING KEY (id) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT b, min(c.least) FROM components c JOIN links ON c.id = a JOIN recurring.components r ON r.id = b
    GROUP BY b HAVING min(c.least) < min(r.least)
)
SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept
FROM embeddings JOIN components ON id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id
""",
    "op11_periodic_runs": r"""
WITH bits AS (
    SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda x, i:
        CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, c)) AS crc_table
), hashed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
               lambda x, c: xor(x >> 8, crc_table[(xor(x, c) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
    FROM documents, bits
), planted AS (
    SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS is_planted,
           CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS k
    FROM hashed
), texts AS (
    SELECT doc_id, n, CASE WHEN is_planted THEN list_transform(range(n), lambda i: w[1 +
        CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + k)) ELSE i END]) ELSE w END AS w
    FROM planted
), places AS (
    SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word, w FROM texts WHERE n >= 24
), grams AS (
    SELECT doc_id, n, i, hash(array_to_string(w[i + 1 : i + 16], ' ')) AS gram,
           array_to_string(w[i + 1 : i + 16], ' ') AS words FROM places WHERE i + 16 <= n
), agree AS (  -- every run has 16 words or more that stand again one period on
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y
    ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.words = y.words AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM agree
), stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM islands
    GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)
), runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), listed AS (
    SELECT doc_id, count(*) AS n_runs,
           string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY doc_id
), longest AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM runs
), dropped AS (
    SELECT DISTINCT p.doc_id, p.i FROM places p JOIN runs r
    ON p.doc_id = r.doc_id AND p.i >= r.start + r.period AND p.i < r.start + r.length
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM places ANTI JOIN dropped USING (doc_id, i)
    WHERE doc_id IN (SELECT doc_id FROM listed) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(l.n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256,
       sha256(coalesce(k.words, array_to_string(t.w, ' '))) AS collapsed_sha256
FROM texts t LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT * FROM longest WHERE place = 1) b USING (doc_id)
""",
    "op12_hard_negatives": r"""
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
           CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole a JOIN whole c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(a.v) = len(c.v)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
""",
}
