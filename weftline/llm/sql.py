"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, length(t) AS points, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id ASC NULLS LAST) AS keep_id,
  max(length(t)) OVER (PARTITION BY n) AS most, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND points = most) AS kept, sha256(n) AS text_sha256 FROM g
"""

OP2 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 10
"""

OP3 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT source, source_size, (rk % 3)::INTEGER AS kind, CASE rk % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS stop FROM s),
o AS (SELECT *, stop / w AS ratio, coalesce(sum(stop) OVER (ORDER BY stop / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
  sum(w) OVER (ORDER BY stop / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
l AS (SELECT min_by((budget - cut) / left_w, ratio) AS level FROM o WHERE (budget - cut) / left_w < ratio),
t AS (SELECT source, source_size, kind, CASE WHEN level IS NULL THEN stop ELSE least(stop, level * w) END AS target FROM w CROSS JOIN l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.kind, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.code, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS base FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, base * size + greatest(0, least(size, round(target)::BIGINT - base * source_size - place)) AS taken, least(place::DOUBLE / greatest(round(target), 1.0), 1.0::DOUBLE) AS f FROM p)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE kind WHEN 0 THEN 0.0::DOUBLE + 2.0::DOUBLE * f / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * f))
    WHEN 1 THEN 0.0::DOUBLE + 2.0::DOUBLE * f / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
    ELSE CASE WHEN f <= 0.375 THEN 0.0::DOUBLE + 2.0::DOUBLE * f / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * f))
      ELSE 0.5::DOUBLE + 2.0::DOUBLE * (f - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2.0::DOUBLE * (f - 0.375::DOUBLE))) END END AS position
FROM x
"""

OP4 = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
n AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM n),
f AS (SELECT h, min(doc_id) AS lo FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT k.doc_id, k.i FROM k JOIN f ON k.h = f.h WHERE k.doc_id > f.lo),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS p FROM hit),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
m AS (SELECT w.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN w.word END, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(m.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256 FROM d LEFT JOIN m ON d.doc_id = m.doc_id
"""

ALL = {"op1_exact_dedup": OP1, "op2_topk": OP2, "op3_mixing": OP3, "op4_substrings": OP4}
