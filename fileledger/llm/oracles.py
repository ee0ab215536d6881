"""SQL for the operators whose results SQL can express. The others are tested against brute force."""

from __future__ import annotations

MIXING = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM sized GROUP BY source
), total AS (SELECT CAST(sum(size) AS BIGINT) * 1.5::DOUBLE AS share FROM sized),
levels AS (
  SELECT 0 AS step, 0.0::DOUBLE AS level, TRUE AS moved
  UNION ALL
  SELECT step + 1, greatest(level, raised), raised > level
  FROM (
    SELECT l.step, l.level,
      coalesce((SELECT ((SELECT share FROM total) - coalesce(sum(CASE WHEN 2 * source_size <= l.level * weight THEN 2 * source_size END), 0))
         / nullif(coalesce(sum(CASE WHEN 2 * source_size > l.level * weight THEN weight END), 0), 0)::DOUBLE FROM sources), l.level) AS raised
    FROM levels l WHERE l.moved AND l.step < 1000
  )
), aimed AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM sources
), placed AS (
  SELECT s.*, a.source_size, a.target, CAST(floor(a.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END * size
       + greatest(0, least(size, budget - CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END * source_size - before)) AS BIGINT) AS taken
FROM placed
"""

HAMMING = """
WITH coded AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.bits, v.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM coded q JOIN coded v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.bits) = len(v.bits)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


#: crc32 (polynomial 0xEDB88320) of the text {0}, from the table of all bytes.
CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(CAST(range(256) AS BIGINT[])) AS n)
  )
)"""


def crc32(text: str) -> str:
    digits = f"hex(encode({text}))"
    one = f"list_transform(range(0, CAST(length({digits}) AS BIGINT), 2), lambda i: CAST('0x' || substr({digits}, i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {one}), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"


PREFIX_TRIE = f"""
WITH {CRC_TABLE}, named AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS k
  FROM named
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM named), crc_table
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.k <= i.h
  UNION ALL
  SELECT i.conv_id, 1, t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.k > i.h
), paths AS (
  SELECT i.conv_id, coalesce(p.path, []) AS path, coalesce(p.sizes, []) AS sizes FROM ids i LEFT JOIN (
    SELECT conv_id, list(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) ORDER BY part, k) AS path, list(length(text) ORDER BY part, k) AS sizes
    FROM rebuilt GROUP BY conv_id
  ) p ON p.conv_id = i.conv_id
), member AS (
  SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path, sizes FROM paths
), nodes AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS size,
         sha256(coalesce(string_agg(CASE WHEN len(path) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM member GROUP BY path[1:depth], depth
), kids AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY node[1:depth - 1]
), own AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node
), below AS (
  SELECT node[1:above] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS above FROM own) GROUP BY node[1:above]
)
SELECT CAST(o.conv_id AS BIGINT) AS conv_id, CAST(o.depth AS BIGINT) AS depth,
       CAST(CASE WHEN o.depth > 0 THEN p.conv_id END AS BIGINT) AS parent_conv_id, CAST(o.n_convs AS BIGINT) AS n_convs,
       CAST(o.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN below b ON b.node = o.node LEFT JOIN nodes p ON o.depth > 0 AND p.node = o.node[1:o.depth - 1]
"""

RESAMPLING = rf"""
WITH {CRC_TABLE}, low AS (
  SELECT doc_id, row_number() OVER () AS line, FALSE AS wanted, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT NULL, NULL, TRUE, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), found AS (
  SELECT doc_id, line, wanted, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM low
), words AS (
  SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM found), crc_table
), counted AS (
  SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t FROM found JOIN words USING (word) GROUP BY bucket
), sums AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM counted),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM counted, sums
), weighed AS (
  SELECT line, count(*) AS n, sum(gain) AS weight FROM found JOIN words USING (word) JOIN gains USING (bucket) WHERE NOT wanted GROUP BY line
), scored AS (
  SELECT l.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(l.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS BIGINT) AS score
  FROM low l LEFT JOIN weighed w ON w.line = l.line WHERE NOT l.wanted
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST, weight, n_features) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored
)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS BIGINT) AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIXING, "op9_hamming": HAMMING, "op12_prefix_trie": PREFIX_TRIE, "op13_resampling": RESAMPLING}
