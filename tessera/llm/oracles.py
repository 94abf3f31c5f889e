"""SQL of the operators that SQL can express, for the tables as views."""

from __future__ import annotations

from tessera.llm.mixing import BLOCK_TOKENS, LIMIT, SEED

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh
  FROM d
),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
),
l AS (SELECT i, j FROM p WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r(id, top) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT b.j, r.top FROM r JOIN both_ways b ON b.i = r.id AND r.top < b.j
),
c AS (SELECT id, min(top) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.id = s.doc_id"""


def _hash(text: str) -> str:
    return f"('0x' || substr(md5('{SEED}:' || {text}), 1, 8))::BIGINT"


OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, 's:' || source AS key, doc_id::VARCHAR AS id, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS n
  FROM documents
),
t AS (SELECT key, sum(n)::DOUBLE AS tokens FROM d GROUP BY key HAVING sum(n) > 0),
b(step, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN low ELSE (low + high) / 2 END, CASE WHEN good THEN (low + high) / 2 ELSE high END
  FROM (
    SELECT step, low, high,
      (SELECT max(pow(t.tokens / a.every, (low + high) / 2) * a.every / t.tokens) FROM t, (SELECT sum(tokens) AS every FROM t) a)
      / (SELECT sum(pow(t.tokens / a.every, (low + high) / 2)) FROM t, (SELECT sum(tokens) AS every FROM t) a) <= {LIMIT} AS good
    FROM b WHERE step < 50
  )
),
a AS (SELECT round(high, 9) AS a, (SELECT sum(tokens) FROM t) AS every FROM b WHERE step = 50),
z AS (SELECT sum(pow(tokens / every, a)) AS z FROM t, a),
w AS (
  SELECT key, tokens, round(pow(tokens / every, a) / z, 9) AS weight, round(pow(tokens / every, a) / z * every / tokens, 9) AS shown,
         ceil(tokens / {BLOCK_TOKENS})::BIGINT AS blocks
  FROM t, a, z
),
p AS (
  SELECT d.*, w.weight, floor(shown)::BIGINT AS passes, floor((shown - floor(shown)) * tokens) AS rest,
         {_hash("d.id")} AS hash, ({_hash("d.id")} * blocks) // 4294967296 AS block
  FROM d LEFT JOIN w USING (key)
),
q AS (SELECT *, {_hash("key || ':' || block::VARCHAR")} AS block_rank FROM p),
o AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY block_rank, block, hash, id) - n AS used FROM q)
SELECT doc_id, source, n::BIGINT AS n_tokens, coalesce(weight, 0)::DOUBLE AS weight,
       CASE WHEN n = 0 OR passes IS NULL THEN 1 ELSE passes + (used < rest)::INTEGER END::BIGINT AS copies, block_rank, hash
FROM o"""
