"""DuckDB SQL for the operators that SQL expresses: plain statements of the result, without the index or ledger."""

from plumbline.llm.secrets import RULES

OP1 = r"""
WITH w AS (SELECT 0 AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM s d JOIN s b ON d.g = b.g AND d.side = 0 AND b.side = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, k AS n_shared, k / n AS containment FROM m JOIN n ON n.id = item_id WHERE k / n >= 0.8
"""

_WORDS = r"CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT"

OP3 = f"""
WITH d AS (SELECT doc_id, source, {_WORDS} AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((place - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS goal FROM src),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, place, least(cap, coalesce((SELECT arg_min(level, (cap / w, place)) FROM l WHERE cap / w >= level) * w, cap)) AS target FROM l),
q AS (SELECT place, target / (2 * k + 1) AS q, k FROM t, range((SELECT round(sum(target) / 32)::BIGINT + 1 FROM t)) r(k) WHERE target > 0),
won AS (SELECT place, count(*) AS blocks FROM (SELECT * FROM q ORDER BY q DESC, place, k LIMIT (SELECT round(sum(target) / 32)::BIGINT FROM t)) GROUP BY place),
s AS (SELECT t.*, coalesce(blocks, 0) AS blocks, greatest(1, ceil(source_size / 200000))::BIGINT AS shards FROM t LEFT JOIN won USING (place)),
g AS (SELECT doc_id, d.source, d.size, s.source_size, s.target, s.place, blocks, md5('7:' || doc_id) AS mark, ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT % shards AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
h AS (SELECT place, shard, sum(size)::BIGINT AS shard_size, any_value(blocks) AS blocks FROM g GROUP BY ALL),
hq AS (SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS r, blocks FROM h, range((SELECT max(blocks) + 1 FROM h)) x(k) WHERE shard_size > 0 AND k <= blocks),
hw AS (SELECT h.*, coalesce(n, 0) AS quota FROM h LEFT JOIN (SELECT place, shard, count(*) AS n FROM hq WHERE r <= blocks GROUP BY ALL) USING (place, shard)),
p AS (SELECT *, least(floor(quota * 32 / shard_size), 2)::BIGINT AS passes, ceil(shard_size / 32)::BIGINT AS nb FROM hw WHERE shard_size > 0),
e AS (SELECT *, CASE WHEN passes >= 2 THEN 0 ELSE least(nb, round((quota * 32 - passes * shard_size) / 32)) END AS extra FROM p),
c AS (SELECT place, shard, b FROM (SELECT place, shard, b, extra, row_number() OVER (PARTITION BY place, shard ORDER BY md5('7:' || place || ':' || shard || ':' || b), b) AS r FROM e, range((SELECT max(nb) FROM e)) y(b) WHERE b < nb) WHERE r <= extra),
o AS (SELECT doc_id, place, shard, size, sum(size) OVER (PARTITION BY place, shard ORDER BY mark, doc_id) AS fin FROM g WHERE size > 0),
x AS (SELECT o.doc_id, sum(least(fin, (b + 1) * 32) - greatest(fin - size, b * 32)) AS picked FROM o JOIN c ON o.place = c.place AND o.shard = c.shard AND b * 32 < fin AND (b + 1) * 32 > fin - size GROUP BY 1)
SELECT g.doc_id, g.source, g.size, g.source_size, g.target, (coalesce(passes * g.size, 0) + coalesce(picked, 0))::BIGINT AS taken
FROM g LEFT JOIN e ON g.place = e.place AND g.shard = e.shard LEFT JOIN x ON g.doc_id = x.doc_id
"""


def _spans() -> str:
    parts = []
    for rank, (kind, pattern, least, group, _) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS vals FROM t"
        )
    return " UNION ALL ".join(parts)


OP7 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS ({_spans()}),
u AS (SELECT doc_id, rank, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals FROM r),
v AS (SELECT doc_id, rank, kind, least, length(hits[i]) AS n, length(vals[i]) AS k,
 sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, rank ORDER BY i) AS fin FROM u),
f AS (SELECT doc_id, rank, kind, (fin - n)::BIGINT AS a, fin::BIGINT AS z FROM v WHERE k >= least),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
 coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < 3), '') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""

OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM documents JOIN r ON r.node = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS g FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(g, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(g, 9, 8))::BIGINT % (len(u) + 1) AS b, ('0x' || substr(g, 17, 8))::BIGINT AS h3, ('0x' || substr(g, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, n, t, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
 coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM f
"""
