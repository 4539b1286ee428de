"""DuckDB SQL for those of the queries that SQL can express."""

#: Resharing until no target is above its limit ends at one unit of weight: sources close in the order of limit / weight.
_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS key
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), capped AS (
  SELECT *, 2.0 * source_size / w AS ratio FROM src
), ordered AS (
  SELECT *, coalesce(sum(2.0 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
         sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         (SELECT 1.5 * sum(source_size) FROM src) AS total
  FROM capped
), level AS (
  SELECT arg_min((total - capped_before) / w_left, ratio) AS unit FROM ordered WHERE (total - capped_before) / w_left <= ratio
), wanted AS (
  SELECT source, source_size, CASE WHEN unit IS NULL THEN 2.0 * source_size ELSE least(2.0 * source_size, unit * w) END::DOUBLE AS target
  FROM ordered, level
), run AS (
  SELECT s.doc_id, s.size, w.source_size, w.target, floor(w.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM run
"""

#: Bytes as pairs of hexadecimal digits; every window of 50 bytes with the smallest document that has it.
_SUFFIX = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, q, md5_number(substr(h, (2 * q + 1)::BIGINT, 100)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS q FROM d)
), f AS (
  SELECT k, min(doc_id) AS first FROM w GROUP BY k
), c AS (
  SELECT doc_id, q, max(q + 50) OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM w JOIN f USING (k) WHERE first < doc_id
), g AS (
  SELECT doc_id, q, sum(CASE WHEN reach IS NULL OR q > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY q) AS run FROM c
), s AS (
  SELECT doc_id, run, min(q) AS a, max(q) + 50 AS b FROM g GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE list_aggregate(list_transform(range(0, len(starts) + 1),
    lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE ends[i] END) + 1, 2 * ((CASE WHEN i = len(starts) THEN len(h) // 2 ELSE starts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE ends[i] END)))), 'string_agg', '') END)) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id)
"""

ORACLES: dict[str, str] = {"op5_mixing": _MIX, "op6_suffix": _SUFFIX}
