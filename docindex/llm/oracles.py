"""DuckDB SQL for the operators' queries, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {}

SQL["op2_chat_format"] = """
WITH RECURSIVE calls AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
chain AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, chain.level + 1 FROM chain JOIN calls c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 2
),
linked AS (
  SELECT c.conv_id, c.turn, chain.level, c.text, a.text AS result, a.conv_id IS NOT NULL AS answered
  FROM calls c JOIN chain ON chain.conv_id = c.conv_id AND chain.turn = c.turn
  LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'
)
SELECT conv_id, turn, 'call' AS kind, 'c' || turn AS call_id, level::BIGINT AS level,
       CASE WHEN answered THEN 'linked' ELSE 'unanswered' END AS status, true AS valid, '' AS errors,
       json_object('arguments', json_object('text', text, 'turn', turn), 'id', 'c' || turn, 'level', level, 'name', 'reply',
                   'result', result, 'status', CASE WHEN answered THEN 'linked' ELSE 'unanswered' END, 'valid', true)::VARCHAR AS json
FROM linked
UNION ALL
SELECT r.conv_id, r.turn, 'result', 'c' || (r.turn - 1), NULL, 'orphan', NULL, NULL,
       json_object('content', r.text, 'id', 'c' || (r.turn - 1), 'role', 'tool', 'status', 'orphan')::VARCHAR
FROM conversations r WHERE r.role = 'assistant'
  AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.turn = r.turn - 1)
UNION ALL
SELECT conv_id, turn, 'message', NULL, NULL, 'message', NULL, NULL, json_object('content', text, 'role', role)::VARCHAR
FROM conversations WHERE role NOT IN ('user', 'assistant')
"""

SQL["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

SQL["op4_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
wins AS (SELECT doc_id, p, hash(array_to_string(w[p:p + 34], ' ')) AS h1, md5_number(array_to_string(w[p:p + 34], ' ')) AS h2 FROM starts),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h1, h2) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM again, range(0, 35) r(k)),
words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (
  SELECT words.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op5_ngram_join"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
root AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT root.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, root.doc_id = component_id AS kept
FROM root LEFT JOIN n ON n.doc_id = root.doc_id
"""

SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""
