"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP5 = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
         CAST(coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_before
  FROM sources
  WINDOW b AS (ORDER BY (3 * source_size) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * (all_w - w_before) <= w * (total - cap_before) AS capped FROM ranked),
goals AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(w AS DOUBLE) * (total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT))
                   / (all_w - CAST(sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS BIGINT)) END AS target
  FROM capped),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
extra AS (SELECT *, target - whole * source_size AS extra FROM parts),
units AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source, h),
placed AS (
  SELECT source, h, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2 AS middle
  FROM units)
SELECT s.doc_id, s.source, s.size, e.source_size, e.target,
       e.whole + CASE WHEN p.middle <= e.extra AND e.extra > 0 THEN 1 ELSE 0 END AS reps,
       s.size * (e.whole + CASE WHEN p.middle <= e.extra AND e.extra > 0 THEN 1 ELSE 0 END) AS taken
FROM sized s
JOIN extra e ON s.source IS NOT DISTINCT FROM e.source
JOIN placed p ON s.source IS NOT DISTINCT FROM p.source AND s.h = p.h
"""

# every pair of lines one edit apart agrees on its first or on its last 10 characters (lines have 20 at least)
OP3 = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, no, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM raw),
firsts AS (
  SELECT line, length(line) AS n, min(struct_pack(d := doc_id, no := no)) AS first FROM lines WHERE line <> '' GROUP BY line),
long AS (SELECT * FROM firsts WHERE n >= 20),
near AS (
  SELECT DISTINCT b.line FROM long a JOIN long b
    ON left(a.line, 10) = left(b.line, 10) AND abs(a.n - b.n) <= 1 AND a.first < b.first
  WHERE CASE WHEN abs(a.n - b.n) <= 1 THEN levenshtein(a.line, b.line) <= 1 ELSE false END
  UNION
  SELECT DISTINCT b.line FROM long a JOIN long b
    ON right(a.line, 10) = right(b.line, 10) AND abs(a.n - b.n) <= 1 AND a.first < b.first
  WHERE CASE WHEN abs(a.n - b.n) <= 1 THEN levenshtein(a.line, b.line) <= 1 ELSE false END),
judged AS (
  SELECT l.doc_id, l.no, r.raw, n.line IS NOT NULL AS near,
         l.line <> '' AND n.line IS NULL AND struct_pack(d := l.doc_id, no := l.no) > f.first AS equal
  FROM lines l JOIN raw r USING (doc_id, no)
  LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(j.raw, chr(10) ORDER BY j.no) FILTER (NOT j.near AND NOT coalesce(j.equal, false)), '') END AS text,
       CAST(count(j.no) AS BIGINT) AS lines,
       CAST(count(*) FILTER (j.equal) AS BIGINT) AS equal_dropped, CAST(count(*) FILTER (j.near) AS BIGINT) AS near_dropped
FROM documents d LEFT JOIN judged j USING (doc_id)
GROUP BY d.doc_id, d.text
"""

OP1 = """
WITH rows AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

OP6 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
shown AS (
  SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS shown_role,
         regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS shown_text
  FROM turns)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || shown_role || chr(10) || shown_text || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

ORACLE: dict[str, str] = {"op1_exact_top_k": OP1, "op3_line_dedup": OP3, "op5_mix_sources": OP5, "op6_chat_format": OP6}
