"""DuckDB texts of the queries that SQL can express."""

from arbor.llm import oracle_merkle, oracle_vectors

ORACLE = {
    "op6_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents),
        r AS (
          SELECT doc_id, norm,
                 first_value(doc_id) OVER w AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size,
                 row_number() OVER w = 1 AS kept
          FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r""",
    "op10_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k,
                 unnest(string_split(coalesce(text, ''), chr(10))) AS line
          FROM documents),
        t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS body FROM l),
        b AS (
          SELECT body FROM t WHERE body <> ''
          GROUP BY body HAVING count(DISTINCT coalesce('=' || source, '')) >= 8),
        m AS (SELECT t.*, b.body IS NOT NULL AS gone FROM t LEFT JOIN b USING (body)),
        o AS (
          SELECT doc_id, count(*) FILTER (gone) AS n_removed,
                 coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS left_text
          FROM m GROUP BY doc_id)
        SELECT doc_id, n_removed, length(left_text) AS n_chars, sha256(left_text) AS text_sha256 FROM o""",
}

_HASH = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT"

#: The mix: targets in closed form, then one threshold round and three fills,
#: each a running sum in order of the hash.
ORACLE["op5_mixing"] = rf"""
    WITH d0 AS (
      SELECT doc_id, source, {_HASH} AS h,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
      FROM documents),
    s0 AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d0 GROUP BY source),
    s1 AS (
      SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
      FROM s0 WINDOW p AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
    s2 AS (
      SELECT (total - used)::DOUBLE AS rest, open::DOUBLE AS open FROM s1
      WHERE cap::DOUBLE * open >= w * (total - used)::DOUBLE
      ORDER BY used, rest, open LIMIT 1),
    s3 AS (
      SELECT source, source_size, least(cap::DOUBLE, w * s2.rest / s2.open) AS target FROM s1, s2),
    s4 AS (
      SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS n
      FROM s3),
    g AS (
      SELECT *, CASE WHEN n < 3 THEN target - n * source_size ELSE 0 END AS budget FROM s4),
    r0 AS (SELECT d0.*, g.source_size, g.target, g.n, g.budget AS b0
           FROM d0 JOIN g ON d0.source IS NOT DISTINCT FROM g.source),
    r1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) <= b0 AS t0 FROM r0),
    q1 AS (SELECT *, b0 - coalesce(sum(size) FILTER (t0) OVER (PARTITION BY source), 0) AS b1 FROM r1),
    r2 AS (SELECT *, NOT t0 AND size <= b1
             AND sum(CASE WHEN NOT t0 AND size <= b1 THEN size ELSE 0 END)
                 OVER (PARTITION BY source ORDER BY h) <= b1 AS t1 FROM q1),
    q2 AS (SELECT *, b1 - coalesce(sum(size) FILTER (t1) OVER (PARTITION BY source), 0) AS b2 FROM r2),
    r3 AS (SELECT *, NOT t0 AND NOT t1 AND size <= b2
             AND sum(CASE WHEN NOT t0 AND NOT t1 AND size <= b2 THEN size ELSE 0 END)
                 OVER (PARTITION BY source ORDER BY h) <= b2 AS t2 FROM q2),
    q3 AS (SELECT *, b2 - coalesce(sum(size) FILTER (t2) OVER (PARTITION BY source), 0) AS b3 FROM r3),
    r4 AS (SELECT *, NOT t0 AND NOT t1 AND NOT t2 AND size <= b3
             AND sum(CASE WHEN NOT t0 AND NOT t1 AND NOT t2 AND size <= b3 THEN size ELSE 0 END)
                 OVER (PARTITION BY source ORDER BY h) <= b3 AS t3 FROM q3)
    SELECT doc_id, size, source_size, target,
           size * (n + CASE WHEN t0 OR t1 OR t2 OR t3 THEN 1 ELSE 0 END) AS taken FROM r4"""

ORACLE["op11_hard_negatives"] = oracle_vectors.HARD_NEGATIVES
ORACLE["op12_merkle"] = oracle_merkle.text()
