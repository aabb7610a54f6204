"""SQL of the contract queries that SQL can express (DuckDB)."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT rid, doc_id, array_to_string(list_slice(ws, k, k + 4), ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM docs WHERE len(ws) > 0)
), size AS (SELECT rid, doc_id, count(*) AS n FROM sh GROUP BY 1, 2),
pairs AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM pairs JOIN size x ON x.rid = a JOIN size y ON y.rid = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS d, b AS r FROM edges
  UNION
  SELECT reach.d, edges.b FROM reach JOIN edges ON reach.r = edges.a
), least_ AS (SELECT d, min(r) AS r FROM reach GROUP BY d)
SELECT docs.doc_id, coalesce(size.n, 0) AS n_shingles, least(docs.doc_id, coalesce(least_.r, docs.doc_id)) AS component_id,
  docs.doc_id = least(docs.doc_id, coalesce(least_.r, docs.doc_id)) AS kept
FROM docs LEFT JOIN size USING (rid) LEFT JOIN least_ ON least_.d = docs.doc_id
"""

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, list_slice(ws, k, k + 9) AS w
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM items WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT len(w) AS l FROM win),
found AS (
  SELECT rid, k, l, item_id FROM (
    SELECT rid, l, k, list_slice(ws, k, k + l - 1) AS w FROM (SELECT rid, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM docs, sizes)
  ) JOIN win USING (w)
), hits AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + l)) AS p FROM found) GROUP BY rid
), who AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN who USING (rid)
"""

PASSAGES = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT rid, p, md5_number(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS w FROM (SELECT rid, h, unnest(range(0, n - 199)) AS p FROM docs)
), twice AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT rid, p, p - coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -1000) > 200 AS fresh FROM win JOIN twice USING (w)
), spans AS (
  SELECT rid, min(p) AS a, max(p) + 200 AS b FROM (SELECT rid, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY rid ORDER BY p) AS g FROM gone) GROUP BY rid, g
), cut AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans
), kept AS (
  SELECT cut.rid, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS n_spans
  FROM cut JOIN docs USING (rid) GROUP BY cut.rid
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""
