"""SQL of the queries that SQL can express, for DuckDB on the same tables.

The others rest on hashes (op1, op2, op3, op7), byte-pair merges (op8), images (op9) or bytes of texts (op10) that
it has no words for; tests hold those against brute force.
"""

ANN = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
  GROUP BY vec_id),
met AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND len(v.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM met QUALIFY rank <= 20"""

CHAT = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, concat_ws(':', conv_id::VARCHAR, turn::VARCHAR) AS call_id, text,
    CASE role WHEN 'user' THEN 'ask' WHEN 'system' THEN 'instruct' ELSE role END AS name
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
results AS (SELECT conv_id, turn AS r_turn, concat_ws(':', conv_id::VARCHAR, (turn - 1)::VARCHAR) AS call_id, text AS result FROM conversations WHERE role = 'assistant'),
levels AS (
  SELECT conv_id, turn, 0::BIGINT AS level FROM calls AS c WHERE NOT EXISTS (SELECT 1 FROM calls AS p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM levels AS l JOIN calls AS c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2),
met AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.name, l.level, c.turn, r.r_turn,
    CASE WHEN c.call_id IS NULL THEN 'no_call' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
    CASE WHEN c.call_id IS NULL THEN ['call: missing']
      WHEN c.name IN ('ask', 'instruct') THEN list_filter([CASE WHEN c.text IS NULL THEN 'text: missing' END, CASE WHEN c.text = '' THEN 'text: minLength 1' END, CASE WHEN c.turn < 0 THEN 'turn: minimum 0' END], lambda e: e IS NOT NULL)
      ELSE ['name: unknown tool'] END AS errors,
    '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{' || coalesce('"text":' || to_json(c.text)::VARCHAR || ',', '') || '"turn":' || c.turn || '}' END
      || ',"call_id":' || to_json(coalesce(c.call_id, r.call_id))::VARCHAR || ',"name":' || coalesce(to_json(c.name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(r.result)::VARCHAR, 'null') || '}' AS json
  FROM calls AS c LEFT JOIN levels AS l ON l.conv_id = c.conv_id AND l.turn = c.turn FULL JOIN results AS r ON r.conv_id = c.conv_id AND r.call_id = c.call_id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY level IS NULL, level, turn NULLS FIRST, call_id, r_turn NULLS FIRST, json) - 1 AS position, call_id, name, level, status, len(errors) = 0 AS valid, errors, json
FROM met"""

LM_SCORING = r"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT place, unnest(list_prepend('', words)[:len(words)]) AS v, unnest(words) AS w FROM docs),
own AS (SELECT place, v, w, count(*) AS n FROM grams GROUP BY ALL),
pairs AS (SELECT v, w, sum(n) AS n FROM own GROUP BY ALL),
contexts AS (SELECT v, sum(n) AS n FROM pairs GROUP BY v),
single AS (SELECT w, sum(n) AS n FROM pairs GROUP BY w),
scores AS (
  SELECT place, sum(own.n * CASE WHEN pairs.n > own.n THEN ln((pairs.n - own.n) / contexts.n) ELSE ln(0.4 * single.n / (SELECT sum(n) FROM single)) END) AS score
  FROM own JOIN pairs USING (v, w) JOIN contexts USING (v) JOIN single USING (w) GROUP BY place)
SELECT doc_id, len(words) AS n_words, coalesce(score, 0.0) AS log_score, CASE WHEN len(words) > 0 THEN score / len(words) END AS mean_log_score
FROM docs LEFT JOIN scores USING (place)"""

SQL = {"op4_ann": ANN, "op5_chat": CHAT, "op6_lm_scoring": LM_SCORING}
