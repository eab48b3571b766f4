"""Check SQL (DuckDB) of the operators that SQL can express; plain and slow, meant for small tables."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 13) AS n FROM bw WHERE len(w) > 0),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bn, unnest(range(1, len(w) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM bn),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, n, i, item FROM places JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM dw, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM dw WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least_of AS (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(least_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of l USING (doc_id)
"""

REPEATED_WORDS = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM dw, unnest(range(1, len(w) - 18)) AS t(i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS place FROM starts),
gone AS (SELECT DISTINCT doc_id, p FROM ranked, unnest(range(i, i + 20)) AS u(p) WHERE place > 1),
kept AS (SELECT dw.doc_id, string_agg(w[t.p], ' ' ORDER BY t.p) AS text
  FROM dw, unnest(range(1, len(w) + 1)) AS t(p) LEFT JOIN gone g ON g.doc_id = dw.doc_id AND g.p = t.p WHERE g.p IS NULL GROUP BY dw.doc_id),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM dw LEFT JOIN removed r ON r.doc_id = dw.doc_id LEFT JOIN kept k ON k.doc_id = dw.doc_id
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM dw, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM dw WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least_of AS (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of l USING (doc_id)
"""

# CRC-32 of a feature: its bytes, read from hexadecimal digits, go one by one through the register.
RESAMPLING = rf"""
WITH RECURSIVE bits(v, c, n) AS (SELECT v, v, 0 FROM range(256) AS t(v) UNION ALL
  SELECT v, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
step AS (SELECT list(c ORDER BY v) AS tab FROM bits WHERE n = 8),
rows AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (SELECT side, id, unnest(w) AS f FROM rows
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM rows, unnest(range(1, len(w))) AS t(i)),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
coded AS (SELECT f, (xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000) AS bucket FROM hexed, step),
placed AS (SELECT side, id, bucket FROM features JOIN coded USING (f)),
tally AS (SELECT b.bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM range(10000) AS b(bucket) LEFT JOIN placed p ON p.bucket = b.bucket GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM tally),
sums AS (SELECT id, count(*) AS n, sum(gain) AS total FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
noise AS (SELECT id, len(w) AS n_words, CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS g FROM rows WHERE side = 0),
weighed AS (SELECT id, n_words, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight, g FROM noise LEFT JOIN sums USING (id)),
placed_in AS (SELECT id, row_number() OVER (ORDER BY weight + g DESC, id) AS r, count(*) OVER () AS able FROM weighed WHERE n_words >= 20)
SELECT id AS doc_id, n_features, weight, weight + g AS score, CASE WHEN r <= 25 * able // 100 THEN r END AS rank
FROM weighed LEFT JOIN placed_in USING (id)
"""


def _centroids(rounds: int) -> str:
    """Each round is a step of its own: nearest centroid by (distance, number), then floors of means."""
    near = (
        "SELECT vec_id, v, unnest(b) FROM (SELECT vec_id, v, min({{'distance': "
        "CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'cluster': c}}) AS b "
        "FROM kept, {0} GROUP BY vec_id, v)"
    )
    steps = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INT) AS c, v AS m FROM kept QUALIFY c < 8)",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(f'c{i}')})")
        steps.append(
            f"s{i} AS (SELECT cluster, j, CAST(floor(sum(v[j]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM a{i}, range(1, 65) AS t(j) GROUP BY 1, 2)"
        )
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM c{i} LEFT JOIN "
            f"(SELECT cluster, list(x ORDER BY j) AS n FROM s{i} GROUP BY cluster) ON cluster = c)"
        )
    steps.append(f"last AS ({near.format(f'c{rounds}')})")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM last JOIN c{rounds} ON c = cluster"
    )


CENTROIDS = _centroids(10)
