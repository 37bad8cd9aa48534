"""DuckDB twins of the queries that SQL can express."""

URL_FILTER = r"""
WITH cutup AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cutup
), rules(listed, rule, h, p) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
         ('block', 'net/fr/', 'net', '/fr/')
), strings AS (
  SELECT u.host, u.path, max_by(rule, length(rule)) AS rule, max_by(listed, length(rule)) AS listed
  FROM (SELECT DISTINCT host, path FROM parts) u
  LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
  GROUP BY u.host, u.path
), g AS (
  SELECT host, path, listed, unnest([substr(padded, i, 4) FOR i IN range(1, length(host || path) + 2)]) AS g
  FROM (SELECT *, chr(2) || chr(2) || chr(2) || host || path || chr(3) AS padded FROM strings)
), base AS (
  SELECT g, count(*) FILTER (listed = 'allow') AS a, count(*) FILTER (listed = 'block') AS r FROM g GROUP BY g
), levels AS (
  SELECT k, substr(g, 4 - k, k + 1) AS gk, sum(a) AS na, sum(r) AS nr
  FROM base, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL
), ctx AS (
  SELECT k, substr(gk, 1, k) AS hk, sum(na) AS ha, sum(nr) AS hr,
         count(*) FILTER (na > 0) AS ta, count(*) FILTER (nr > 0) AS tr
  FROM levels GROUP BY ALL
), m AS (
  SELECT l.k, l.gk, na, nr, ha, hr, ta, tr FROM levels l JOIN ctx c ON c.k = l.k AND c.hk = substr(l.gk, 1, l.k)
), v AS (SELECT 1.0::DOUBLE / count(DISTINCT substr(g, 4, 1)) AS u FROM base),
p0 AS (
  SELECT b.g, CASE WHEN ha + ta > 0 THEN (na + ta * u) / (ha + ta) ELSE u END AS pa,
         CASE WHEN hr + tr > 0 THEN (nr + tr * u) / (hr + tr) ELSE u END AS pr
  FROM base b, v, m WHERE m.k = 0 AND m.gk = substr(b.g, 4, 1)
), p1 AS (
  SELECT b.g, CASE WHEN ha + ta > 0 THEN (na + ta * pa) / (ha + ta) ELSE pa END AS pa,
         CASE WHEN hr + tr > 0 THEN (nr + tr * pr) / (hr + tr) ELSE pr END AS pr
  FROM p0 b JOIN m ON m.k = 1 AND m.gk = substr(b.g, 3, 2)
), p2 AS (
  SELECT b.g, CASE WHEN ha + ta > 0 THEN (na + ta * pa) / (ha + ta) ELSE pa END AS pa,
         CASE WHEN hr + tr > 0 THEN (nr + tr * pr) / (hr + tr) ELSE pr END AS pr
  FROM p1 b JOIN m ON m.k = 2 AND m.gk = substr(b.g, 2, 3)
), p3 AS (
  SELECT b.g, CASE WHEN ha + ta > 0 THEN (na + ta * pa) / (ha + ta) ELSE pa END AS pa,
         CASE WHEN hr + tr > 0 THEN (nr + tr * pr) / (hr + tr) ELSE pr END AS pr
  FROM p2 b JOIN m ON m.k = 3 AND m.gk = b.g
), scored AS (
  SELECT host, path, any_value(listed) AS listed, avg(ln(pa) - ln(pr)) AS score
  FROM g JOIN p3 USING (g) GROUP BY host, path
), stats AS (
  SELECT avg(score) FILTER (listed = 'allow') AS ma, stddev_pop(score) FILTER (listed = 'allow') AS sa,
         avg(score) FILTER (listed = 'block') AS mb, stddev_pop(score) FILTER (listed = 'block') AS sb
  FROM scored
), cutoff AS (
  SELECT CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END AS c FROM stats
)
SELECT p.page_id, p.host, p.path, s.rule,
       coalesce(s.listed, CASE WHEN c.c IS NULL OR d.score >= c.c THEN 'allow' ELSE 'block' END) AS verdict
FROM parts p JOIN strings s USING (host, path) JOIN scored d USING (host, path), cutoff c
"""

SAMPLE_MIX = r"""
WITH docs AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE l.q WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id)
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5(doc_id::VARCHAR || 'mix-1'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / weight AS k
  FROM docs
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER o AS rank,
         (sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining_w
  FROM sizes WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST)
), level AS (
  SELECT arg_min(remaining / remaining_w, rank) AS l FROM ordered WHERE remaining / remaining_w * w <= cap
), targets AS (
  SELECT source, source_size, round(CASE WHEN l IS NULL THEN cap ELSE least(cap, l * w) END, 6) AS target FROM ordered, level
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets
), run AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id NULLS LAST, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before < rest AND (before + size <= rest OR before + size - rest < rest - before) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

EXACT_TOPK = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

BLOCK_NAMING = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""

TERM_TREE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), d AS (
  SELECT doc_id, ws, len(ws)::BIGINT AS n FROM words WHERE len(ws) > 0
), whole AS (
  SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d
), m AS (
  SELECT doc_id, 50 + (50 * n * nd) // l AS m FROM d, whole
), tf AS (
  SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS t FROM d) GROUP BY ALL
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), w AS (
  SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), whole
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM item JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
