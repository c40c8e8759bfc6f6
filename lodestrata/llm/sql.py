"""The pN_ queries in SQL, where SQL can express them."""

from __future__ import annotations

from lodestrata.llm.lines import MIN_DOCS, MIN_SHARE, MIN_WORDS

_LINES = rf"""
WITH docs AS (SELECT DISTINCT doc_id, source FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
parts AS (SELECT DISTINCT id, doc_id, text FROM chunks WHERE text IS NOT NULL),
lines AS (SELECT id AS chunk_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM parts),
keyed AS (SELECT l.chunk_id, l.doc_id, l.line_no, d.source, regexp_replace(replace(lower(l.line), 'ß', 'ss'), '[^\p{{L}}]+', '', 'g') AS key
  FROM lines l JOIN docs d USING (doc_id) WHERE regexp_matches(l.line, '(?:\p{{L}}+[^\p{{L}}]+){{{MIN_WORDS - 1}}}\p{{L}}')),
sizes AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
hits AS (SELECT k.source, k.key FROM keyed k JOIN sizes s USING (source) GROUP BY k.source, k.key, s.n
  HAVING count(DISTINCT k.doc_id) >= {MIN_DOCS} AND count(DISTINCT k.doc_id) >= {MIN_SHARE} * s.n)
"""

ORACLE = {
    "p4_found": _LINES + "SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN hits USING (source, key)",
}
