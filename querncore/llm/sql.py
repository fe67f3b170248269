"""SQL of the queries that it can express, each over whole tables and by the plain definition, not by the operator's method."""

from __future__ import annotations


def sort_means_sql(k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> str:
    """All distances of all vectors in each round."""
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    far = "CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(d * {k} + c) % {k} AS c, min(d) AS d FROM (SELECT k.vec_id, k.v, m.c, {far} AS d FROM kept k CROSS JOIN c{r} m) GROUP BY vec_id)")
        if r < rounds:
            ctes.append(f"e{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i)")
            ctes.append(f"m{r} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM e{r} GROUP BY c)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return f"""
WITH {', '.join(ctes)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""


WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM g"""

#: A crc32 by bytes: the 256 remainders come from eight shifts each.
RESAMPLING = r"""
WITH t AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS r FROM range(256) x(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
u AS (SELECT DISTINCT w FROM (SELECT unnest(w) AS w FROM d UNION ALL SELECT unnest(w) FROM b)),
k AS MATERIALIZED (SELECT w, xor(list_reduce(range(CAST(strlen(w) AS BIGINT)), lambda c, i: xor(c // 256, t.r[1 + xor(c % 256, CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT))]), 4294967295), 4294967295) % 10000 AS bucket FROM u, t),
s AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) JOIN k USING (w) GROUP BY bucket),
gain AS (SELECT x.bucket, CAST(floor(1000 * ln(CAST(coalesce(g.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * (coalesce((SELECT sum(n) FROM g), 0) + 10000)))) AS BIGINT) AS gain FROM range(10000) x(bucket) LEFT JOIN s ON s.bucket = x.bucket LEFT JOIN g ON g.bucket = x.bucket),
weight AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN k USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN weight ON weight.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked"""
