"""DuckDB SQL of the operators that SQL can express."""

from candlewright.llm.clustering import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED
from candlewright.llm.prefixtrie import FAMILY

# CRC-32 of an ASCII text, bit by bit: each byte is taken in, then eight times shifted out.
CRC32 = """xor(list_reduce(CAST([4294967295] || flatten(list_transform(string_split({text}, ''),
  lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])) AS BIGINT[]),
  lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""


def clusters_sql():
    """Each round as two common table expressions: every vector against every centroid, then their means."""
    parts = [f"""kept AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept
  ORDER BY c LIMIT {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS (
  SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d * {CLUSTERS} + c) AS best FROM (
    SELECT row_id, vec_id, k.v, c, CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) AS d
    FROM kept k, c{r} m)
  GROUP BY row_id)""")
        if r < ROUNDS:
            parts.append(f"""s{r} AS (
  SELECT best % {CLUSTERS} AS c, i, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n FROM (
    SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2),
c{r + 1} AS (
  SELECT m.c, coalesce(f.v, m.v) AS v FROM c{r} m LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) f ON f.c = m.c)""")
    return "WITH " + ",\n".join(parts) + f""",
found AS (SELECT vec_id, CAST(best % {CLUSTERS} AS INTEGER) AS cluster, CAST(best // {CLUSTERS} AS BIGINT) AS distance FROM a{ROUNDS})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM found JOIN c{ROUNDS} m ON m.c = cluster"""


def prefix_trie_sql():
    """Prefixes as the joined hashes of their turns; subtree sums from each node's smallest member.

    A node's subtree is what its members hold below it, each node counted at its smallest
    member only, so a suffix sum per conversation is enough.
    """
    return f"""WITH turns AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at,
    md5(coalesce(role, '')) || md5(coalesce(text, '')) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c.conv, c.h, c.base, least(c.h, coalesce(b.own, 0)) AS taken, least(c.h, coalesce(b.own, 0)) + greatest(c.own - c.h, 0) AS length
  FROM (SELECT conv, count(*) AS own, conv - conv % {FAMILY} AS base, {CRC32.format(text="CAST(conv AS VARCHAR)")} % 4 AS h FROM turns GROUP BY conv) c
  LEFT JOIN (SELECT conv, count(*) AS own FROM turns GROUP BY conv) b ON b.conv = c.base),
rebuilt AS (
  SELECT c.conv, t.at AS depth, t.h, t.words, length FROM convs c JOIN turns t ON t.conv = c.base AND t.at <= c.h
  UNION ALL
  SELECT c.conv, c.taken + t.at - c.h, t.h, t.words, length FROM convs c JOIN turns t ON t.conv = c.conv AND t.at > c.h
  UNION ALL
  SELECT conv, 0, '', 0, length FROM convs),
prefixes AS (
  SELECT conv, depth, words, length, string_agg(h, '') OVER (PARTITION BY conv ORDER BY depth) AS p FROM rebuilt),
places AS (
  SELECT *, min(conv) OVER (PARTITION BY p) AS rep, count(*) OVER (PARTITION BY p) AS n_convs FROM prefixes),
above AS (
  SELECT *, lag(rep) OVER (PARTITION BY conv ORDER BY depth) AS parent FROM places),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM above WHERE conv = rep AND depth > 0 GROUP BY 1, 2),
own AS (
  SELECT a.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN conv = rep AND n_children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN conv = rep THEN (n_convs - 1) * words ELSE 0 END AS saved
  FROM above a LEFT JOIN children c ON c.parent = a.rep AND c.depth = a.depth),
below AS (
  SELECT *, sum(leaf) OVER w AS leaves, sum(saved) OVER w AS saved_below FROM own WINDOW w AS (PARTITION BY conv ORDER BY depth DESC))
SELECT rep AS conv_id, depth, any_value(parent) AS parent_conv_id, any_value(n_convs) AS n_convs, any_value(n_children) AS n_children,
  CAST(sum(leaves) AS BIGINT) AS n_leaves, CAST(sum(saved_below) AS BIGINT) AS saved_tokens,
  sha256(coalesce(string_agg(CASE WHEN depth = length THEN CAST(conv AS VARCHAR) END, ',' ORDER BY conv), '')) AS ends_sha256
FROM below GROUP BY rep, depth"""
