"""The queries in SQL, for a second engine to run over the same tables."""

from __future__ import annotations

from lodestrata.functions.policy import CUES, DISCLAIMERS, LEGAL, MEDICAL
from lodestrata.functions.text import STOPWORDS, WORD

_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_WORD = WORD.replace("'", "''")
_ACTIVE = "active AS (SELECT doc_id FROM documents WHERE status = 'ready' AND is_deleted = 0)"
_LIVE = f"{_ACTIVE}, live AS (SELECT c.* FROM chunks c WHERE c.embedding_row IS NOT NULL AND c.doc_id IN (SELECT doc_id FROM active))"
_TOKENS = f"""{_LIVE},
rows_ AS (SELECT embedding_row AS row, list_filter(regexp_extract_all(lower(CASE WHEN length(section_title) > 0 THEN section_title || chr(10) || chr(10) || text ELSE coalesce(text, '') END), '{_WORD}'), lambda x: x NOT IN {_STOP}) AS terms FROM live),
dls AS (SELECT row, terms, CAST(len(terms) AS BIGINT) AS dl FROM rows_),
stats AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM dls),
posts AS (SELECT term, row, dl, count(*) AS tf FROM (SELECT row, dl, unnest(terms) AS term FROM dls) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term)"""
_IDF = "greatest(0.01, ln(1.0 + (n - df + 0.5) / (df + 0.5)))"
_ONCE = "once AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY logged_at) = 1)"
_ENGLISH = "english AS (SELECT embedding_row AS row FROM live WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))"


def _terms(source: str, key: str, text: str) -> str:
    return f"(SELECT {key} AS query_id, term, count(*) AS qtf FROM (SELECT {key}, unnest(list_filter(regexp_extract_all(lower({text}), '{_WORD}'), lambda x: x NOT IN {_STOP})) AS term FROM {source}) GROUP BY ALL)"


def _bm25(terms: str, mask: str, k: int) -> str:
    return f"""(SELECT query_id, row, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row) AS BIGINT) AS rank FROM (
  SELECT q.query_id, p.row, sum(q.qtf * {_IDF} * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END))) AS score
  FROM {terms} q JOIN posts p USING (term) JOIN dfs USING (term), stats {mask} GROUP BY ALL) QUALIFY rank <= {k})"""


_QUESTIONS = "(SELECT query_id, query FROM once WHERE query_id % 100 = 0 AND query IS NOT NULL)"
_VECTORS = f"""{_LIVE}, matrix AS (SELECT embedding_row AS row, embedding FROM chunk_vectors WHERE embedding_row IN (SELECT embedding_row FROM live)),
probes AS (SELECT l.embedding_row AS query_id, coalesce(l.section_title, l.text) AS query, v.embedding AS vector FROM live l JOIN chunk_vectors v USING (embedding_row) WHERE l.embedding_row % 100 = 0)"""
_DOT = "list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(p.vector AS DOUBLE[]))"


def _dense(probes: str, mask: str, k: int) -> str:
    return f"""(SELECT query_id, row, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row) AS BIGINT) AS rank FROM (
  SELECT p.query_id, m.row, {_DOT} AS score FROM {probes} p, matrix m {mask}) QUALIFY rank <= {k})"""


def _mmr(window: int, k: int, weight: float) -> str:
    """One pick after the other: each is a common table over those before it."""
    dot = "list_dot_product(CAST({}.embedding AS DOUBLE[]), CAST({}.embedding AS DOUBLE[]))"
    steps = [f"c AS (SELECT d.query_id, d.rank AS r, d.row, d.score, m.embedding FROM {_dense('probes', '', window)} d JOIN matrix m USING (row))", "p1 AS (SELECT query_id, r, 1 AS at FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) = 1)"]
    for n in range(2, k + 1):
        steps.append(f"""p{n} AS (SELECT * FROM p{n - 1} UNION ALL SELECT query_id, r, {n} FROM (SELECT c.query_id, c.r, {weight} * c.score - (1 - {weight}) * max({dot.format('c', 'x')}) AS v
  FROM c JOIN p{n - 1} p USING (query_id) JOIN c x ON x.query_id = p.query_id AND x.r = p.r WHERE NOT EXISTS (FROM p{n - 1} y WHERE y.query_id = c.query_id AND y.r = c.r) GROUP BY c.query_id, c.r, c.score)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, r) = 1)""")
    return ",\n".join(steps) + f" SELECT c.query_id, c.row, round(c.score, 5) AS score, CAST(p.at AS INTEGER) AS rank FROM p{k} p JOIN c USING (query_id, r)"


def _fused(lists: str) -> str:
    return f"""SELECT query_id, row, round(score, 6) AS score, rank FROM (SELECT query_id, row, sum(1.0 / (60 + rank)) AS score, min({{'l': list_id, 'r': rank}}) AS first,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, min({{'l': list_id, 'r': rank}})) AS BIGINT) AS rank FROM ({lists}) GROUP BY query_id, row) WHERE rank <= 10"""


_HYBRID_WITH = _TOKENS + ", " + _VECTORS[_VECTORS.index("matrix AS") :]
_CITED = """cited AS (SELECT query_id, row, min(cite_no) AS cite_no, max(coalesce(score, 0)) AS score FROM (SELECT DISTINCT query_id, cite_no, chunk_id, score FROM citations) c
  JOIN (SELECT id AS chunk_id, embedding_row AS row FROM chunks WHERE embedding_row IS NOT NULL) r USING (chunk_id) GROUP BY query_id, row),
byscore AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cite_no, row) AS rank FROM cited),
bycite AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cite_no, row) AS rank FROM cited)"""
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_WORDS = f"list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '')"
_BLOCKS = """lines AS (SELECT doc_id, page, ordinal, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM (SELECT DISTINCT doc_id, page, ordinal, text FROM chunks)),
blocks AS (SELECT doc_id, page AS page_num, ordinal * 1000 + line AS pos, text, CASE WHEN upper(text) = text AND regexp_matches(text, '[A-Z]') THEN 14.5 ELSE 10.0 + length(text) % 3 END AS font_size,
  CAST((ordinal * 1000 + line) % 7 AS DOUBLE) AS x0, CAST(line * 10 AS DOUBLE) AS y0, CAST(100 + length(text) AS DOUBLE) AS x1, CAST(line * 10 + 10 AS DOUBLE) AS y1 FROM lines),
sizes AS (SELECT doc_id, page_num, round_even(font_size, 0) AS size, sum(length(text)) AS n, min(pos) AS first FROM blocks WHERE font_size > 0 GROUP BY ALL),
body AS (SELECT doc_id, page_num, size AS body FROM sizes QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY n DESC, first) = 1)"""
_TITLED = rf"""{_BLOCKS}, marked AS (SELECT b.*, CAST(font_size >= 1.3 * body AS INTEGER) AS heading FROM blocks b JOIN body USING (doc_id, page_num)),
grouped AS (SELECT *, sum(heading) OVER (PARTITION BY doc_id, page_num ORDER BY pos) AS section FROM marked),
joined AS (SELECT doc_id, page_num, section, regexp_replace(string_agg(text, ' ' ORDER BY pos), '^{_WS}|{_WS}$', '', 'g') AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  nullif(CASE WHEN arg_min(heading, pos) = 1 THEN regexp_replace(arg_min(text, pos), '^{_WS}|{_WS}$', '', 'g') END, '') AS own FROM grouped GROUP BY ALL),
titled AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_num, section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title FROM joined)"""


def _pieces(most: int, step: int) -> str:
    return f"""worded AS (SELECT *, {_WORDS} AS w FROM titled WHERE text <> ''),
parted AS (SELECT *, unnest(CASE WHEN len(w) <= {most} THEN [0] ELSE range(0, CAST(ceil((len(w) - {most}) / {step}.0) AS BIGINT) + 1) END) AS part FROM worded),
pieces AS (SELECT *, CASE WHEN len(w) <= {most} THEN text ELSE array_to_string(w[part * {step} + 1 : part * {step} + {most}], ' ') END AS piece,
  CAST(CASE WHEN len(w) <= {most} THEN len(w) ELSE len(w[part * {step} + 1 : part * {step} + {most}]) END AS INTEGER) AS n_words FROM parted)"""


_TOPIC = f"CASE WHEN regexp_matches(lower(query), '{'|'.join(MEDICAL)}') THEN 'medical' WHEN regexp_matches(lower(query), '{'|'.join(LEGAL)}') THEN 'legal' END"
_EMAIL_RE, _SSN_RE = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\b\d{3}-\d{2}-\d{4}\b"
# RE2 has no looking around: what must not stand before is matched and put back; at the end a boundary of words does
_PHONE_RE = r"(^|[^\pL\pN_])((?:\+?\d{1,3}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4})\b"
_IBAN_RE, _CARD_RE = r"\b([A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30})\b", r"(?:^|\D)((?:\d[ -]?){12,18}\d)(?:\D|$)"
_PLAIN = "regexp_replace(x, '[ -]', '', 'g')"
_IBAN_OK = f"""length({_PLAIN}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), ''),
  lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ord(c) - 55 AS VARCHAR) END), ''), ''), lambda c: CAST(c AS INTEGER))), lambda a, c: (a * 10 + c) % 97) = 1"""
_CARD_OK = r"""length(regexp_replace(x, '\D', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(x, '\D', '', 'g')), ''),
  lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"""


def _valid(text: str, pattern: str, ok: str, put: str) -> str:
    """The text with those matches replaced that are valid."""
    return f"list_reduce(list_prepend({text}, list_filter(regexp_extract_all({text}, '{pattern}', 1), lambda x: {ok})), lambda t, x: replace(t, x, '{put}'))"


def _masked(source: str) -> str:
    """m: the columns of ``source`` (with text), masked and entities, rule by rule."""
    return f"""m1 AS (SELECT *, regexp_replace(text, '{_EMAIL_RE}', '[EMAIL]', 'g') AS t1 FROM {source}), m2 AS (SELECT *, regexp_replace(t1, '{_SSN_RE}', '[SSN]', 'g') AS t2 FROM m1),
m3 AS (SELECT *, regexp_replace(t2, '{_PHONE_RE}', '\\1[PHONE]', 'g') AS t3 FROM m2), m4 AS (SELECT *, {_valid("t3", _IBAN_RE, _IBAN_OK, "[IBAN]")} AS t4 FROM m3),
m5 AS (SELECT *, {_valid("t4", _CARD_RE, _CARD_OK, "[CREDIT_CARD]")} AS masked FROM m4),
m AS (SELECT *, array_to_string(list_filter([CASE WHEN t1 <> text THEN 'email' END, CASE WHEN t2 <> t1 THEN 'ssn' END, CASE WHEN t3 <> t2 THEN 'phone' END, CASE WHEN t4 <> t3 THEN 'iban' END, CASE WHEN masked <> t4 THEN 'credit_card' END], lambda x: x IS NOT NULL), ',') AS entities FROM m5)"""


_PERSONAL = r"regexp_matches(query, '(?i)^\s*(should|can|could|would|do|am)\s+(?:i|we)\b')"

ORACLE = {
    "tokenize_counts": f"WITH {_TOKENS} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM posts GROUP BY term",
    "corpus_stats": f"WITH {_TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "term_idf": f"WITH {_TOKENS} SELECT term, df, round({_IDF}, 6) AS idf FROM dfs, stats",
    "bm25_topk": f"WITH {_TOKENS}, {_ONCE} SELECT query_id, row, round(score, 6) AS score, rank FROM {_bm25(_terms(_QUESTIONS, 'query_id', 'query'), '', 10)}",
    "bm25_saved": f"WITH {_TOKENS}, {_ONCE} SELECT query_id, row, round(score, 6) AS score, rank FROM {_bm25(_terms(_QUESTIONS, 'query_id', 'query'), '', 10)}",
    "bm25_topk_masked": f"WITH {_TOKENS}, {_ONCE}, {_ENGLISH} SELECT query_id, row, round(score, 6) AS score, rank FROM {_bm25(_terms(_QUESTIONS, 'query_id', 'query'), 'WHERE p.row IN (SELECT row FROM english)', 10)}",
    "dense_topk": f"WITH {_VECTORS} SELECT query_id, row, round(score, 5) AS score, rank FROM {_dense('probes', '', 10)}",
    "dense_topk_masked": f"WITH {_VECTORS}, {_ENGLISH} SELECT query_id, row, round(score, 5) AS score, rank FROM {_dense('probes', 'WHERE m.row IN (SELECT row FROM english)', 10)}",
    "hybrid_search": f"WITH {_HYBRID_WITH} "
    + _fused(f"SELECT query_id, 0 AS list_id, row, rank FROM {_dense('probes', '', 50)} UNION ALL SELECT query_id, 1, row, rank FROM {_bm25(_terms('probes', 'query_id', 'query'), '', 50)}"),
    "multi_query_hybrid": f"WITH {_HYBRID_WITH}, more AS (SELECT p.query_id, d.source AS query, p.vector FROM probes p JOIN live l ON l.embedding_row = p.query_id JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL) "
    + _fused(
        f"SELECT query_id, 0 AS list_id, row, rank FROM {_dense('probes', '', 50)} UNION ALL SELECT query_id, 1, row, rank FROM {_bm25(_terms('probes', 'query_id', 'query'), '', 50)} "
        f"UNION ALL SELECT query_id, 2, row, rank FROM {_dense('more', '', 50)} UNION ALL SELECT query_id, 3, row, rank FROM {_bm25(_terms('more', 'query_id', 'query'), '', 50)}"
    ),
    "rerank_merge": f"""WITH {_CITED}, scored AS (SELECT query_id, row, rank AS old, query_id % 5 IN (0, 4) AS kept, CASE query_id % 5 WHEN 1 THEN CASE rank WHEN 1 THEN 1.0 WHEN 2 THEN 0.25 ELSE 0.0 END
  WHEN 2 THEN CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 WHEN 100 THEN 1.0 ELSE 0.0 END WHEN 3 THEN 0.0 ELSE score END AS score FROM bycite)
SELECT query_id, row, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kept THEN 0 ELSE -score END, old) AS rank FROM scored""",
    "mmr_select": f"WITH {_VECTORS}, {_mmr(40, 5, 0.7)}",
    "evidence_gate": f"""WITH {_CITED}, lists AS (SELECT query_id, list(score ORDER BY rank) AS s FROM byscore WHERE rank <= 40 GROUP BY query_id),
gates AS (SELECT query_id, s, s[1] AS top, s[1] >= 0.55 OR len(s) = 1 OR (CASE WHEN s[1] > 0 THEN (s[1] - s[len(s) // 2 + 1]) / s[1] ELSE 0 END) >= 0.15 AS passed FROM lists)
SELECT query_id, passed, round(top, 6) AS top, top < 0.45 AS weak, CAST(CASE WHEN passed THEN len(list_filter(s, lambda x: x > 0)) ELSE 0 END AS BIGINT) AS kept FROM gates""",
    "citations_hydrate": f"""WITH {_CITED} SELECT b.query_id, b.rank AS cite_index, c.doc_id AS document_id, d.filename, c.page, c.id AS chunk_id, c.text, round(b.score, 6) AS score
FROM byscore b JOIN chunks c ON c.embedding_row = b.row JOIN documents d ON d.doc_id = c.doc_id""",
    "verify_support": f"""WITH {_CITED} SELECT query_id, count(*) FILTER (NOT ok) = 0 AS all_supported, coalesce(string_agg(CAST(rank - 1 AS VARCHAR), ',' ORDER BY rank) FILTER (NOT ok), '') AS unsupported
FROM (SELECT b.query_id, b.rank, b.score >= 0.5 AND trim(c.text) <> '' AS ok FROM byscore b JOIN chunks c ON c.embedding_row = b.row JOIN documents d ON d.doc_id = c.doc_id) GROUP BY query_id""",
    "citation_parse": """WITH c AS (SELECT DISTINCT query_id, cite_no, chunk_id, (query_id + cite_no) % 5 AS s, CAST(cite_no AS VARCHAR) AS a, CAST(chunk_id AS VARCHAR) AS b, CAST(query_id AS VARCHAR) AS q FROM citations)
SELECT query_id, cite_no, chunk_id, CASE s WHEN 0 THEN a || ',' || b || ',' || q WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN '' ELSE b || ',' || a || ',' || a END AS cited,
  CASE s WHEN 0 THEN 'Stated and but not [x1].' WHEN 1 THEN 'Is it so ?' WHEN 2 THEN a || ' %' WHEN 3 THEN 'Plain claim ' || b || '.' ELSE 'A [ ' || a || '] [], [1,] end' END AS bare, s NOT IN (1, 2) AS factual FROM c""",
    "split_sentences": rf"""WITH squeezed AS (SELECT doc_id, array_to_string({_WORDS}, ' ') AS t FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, regexp_replace(t, '(^|[^A-Za-z])((?i:dr|mr|mrs|ms|prof|sr|jr|vs|etc))\.', '\1\2' || chr(57345), 'g') AS t FROM squeezed),
cut AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([!?.][''"”’)\]}}]*)\s*([\p{{Lu}}\p{{Nd}}\[(]|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(57345), '.'), ' ')), lambda x: x <> '') AS s FROM kept)
SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS sentence_no, unnest(s) AS sentence FROM cut""",
    "chunk_windows": f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, unnest(CASE WHEN len(w) <= 64 THEN [0] ELSE range(0, CAST(ceil((len(w) - 64) / 48.0) AS BIGINT) + 1) END) AS part, text, w FROM w)
SELECT doc_id, CAST(part AS BIGINT) AS part, CASE WHEN len(w) <= 64 THEN text ELSE array_to_string(w[part * 48 + 1 : part * 48 + 64], ' ') END AS piece,
  CAST(CASE WHEN len(w) <= 64 THEN len(w) ELSE len(w[part * 48 + 1 : part * 48 + 64]) END AS BIGINT) AS n_tokens FROM parts""",
    "body_size_mode": f"WITH {_BLOCKS} SELECT doc_id, page_num, CAST(body AS DOUBLE) AS body FROM body",
    "heading_sections": f"WITH {_TITLED} SELECT doc_id, page_num, CAST(section AS BIGINT) AS section, md5(text) AS text_md5, x0, y0, x1, y1, section_title FROM titled WHERE text <> ''",
    "layout_chunks": f"""WITH {_TITLED}, {_pieces(64, 48)}, scans AS (SELECT DISTINCT doc_id, page FROM chunks WHERE source = 'ocr')
SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY page_num, section, part) - 1 AS INTEGER) AS ordinal, page_num AS page, piece AS text, n_words AS token_count, x0, y1, section_title,
  CASE WHEN s.doc_id IS NULL THEN 'pdf_text' ELSE 'ocr' END AS source FROM pieces p LEFT JOIN scans s ON s.doc_id = p.doc_id AND s.page = p.page_num""",
    "ingest": f"""WITH {_TITLED}, {_pieces(512, 448)}, counts AS (SELECT doc_id, count(*) AS k FROM pieces GROUP BY doc_id)
SELECT CASE WHEN k IS NULL THEN 'failed' ELSE 'ready' END AS status, count(*) AS n, CAST(sum(coalesce(k, 0)) AS BIGINT) AS chunks FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN counts USING (doc_id) GROUP BY 1""",
    "indexed_text": "SELECT id, md5(CASE WHEN length(section_title) > 0 THEN section_title || chr(10) || chr(10) || text ELSE text END) AS text_md5 FROM chunks",
    "pii_email_ssn": r"SELECT DISTINCT query_id, regexp_replace(regexp_replace(query, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g') AS masked FROM requests",
    "pii_full": f"WITH {_masked('(SELECT id, text FROM chunks WHERE text IS NOT NULL)')} SELECT id, masked, entities FROM m",
    "policy_routing": rf"""WITH {_ONCE}, {_masked("(SELECT query_id, coalesce(query, '') AS text FROM once)")}, q AS (SELECT query_id, masked, entities, masked AS query FROM m)
SELECT query_id, masked, entities, {_TOPIC} AS disclaimer, CASE WHEN {_TOPIC} IS NOT NULL AND {_PERSONAL} THEN 'personalized_advice' END AS refuse_reason,
  NOT ({_TOPIC} IS NOT NULL AND {_PERSONAL}) AND {_TOPIC} IS NOT NULL AND regexp_matches(query, '(?i)\b(i|me|my|mine|we|us|our|ours)\b') AND regexp_matches(lower(query), '{"|".join(CUES)}') AS ask_fallback FROM q""",
    "topic_policy": rf"""WITH {_ONCE}, q AS (SELECT query_id, coalesce(query, '') AS query FROM once)
SELECT query_id, {_TOPIC} AS topic, {_TOPIC} IS NOT NULL AND {_PERSONAL} AS personal, regexp_matches(query, '(?i)\b(i|me|my|mine|we|us|our|ours)\b') AND regexp_matches(lower(query), '{"|".join(CUES)}') AS ambiguous FROM q""",
    "transform_parse": f"""WITH {_ONCE}, q AS (SELECT query_id, coalesce(query, '') AS query, query_id % 3 <> 0 AS ok, query_id % 5 AS m, query_id % 2 AS odd FROM once),
i AS (SELECT *, CASE WHEN ok AND m = 0 THEN 'no_search' WHEN ok AND m = 1 THEN 'refuse' ELSE 'search' END AS intent FROM q)
SELECT query_id, intent, CASE WHEN ok AND odd = 0 THEN 'list' END AS sub_intent, CASE WHEN intent <> 'search' THEN '' WHEN ok AND odd = 0 THEN 'rewritten' ELSE query END AS rewritten_query,
  CASE WHEN ok THEN 'a|b|c' ELSE '' END AS expansions, CASE WHEN ok AND odd = 0 THEN 'list' ELSE 'prose' END AS format FROM i""",
    "disclaimers": rf"""WITH {_ONCE}, q AS (SELECT query_id, coalesce(query, '') AS query, regexp_replace(coalesce(query, ''), '^{_WS}|{_WS}$', '', 'g') AS bare FROM once)
SELECT query_id, CASE {_TOPIC} WHEN 'medical' THEN '{DISCLAIMERS["medical"]}' || chr(10) || chr(10) || bare WHEN 'legal' THEN '{DISCLAIMERS["legal"]}' || chr(10) || chr(10) || bare ELSE query END AS answer FROM q""",
    "request_validation": f"""WITH {_ONCE} SELECT query_id, CASE WHEN query IS NULL OR length(query) NOT BETWEEN 1 AND 2000 THEN 'query' WHEN top_k IS NOT NULL AND top_k NOT BETWEEN 1 AND 20 THEN 'top_k'
  WHEN answer_format IS NOT NULL AND answer_format NOT IN ('auto', 'prose', 'list', 'table', 'json') THEN 'format' END AS error FROM once""",
    "request_dedup": f"WITH {_ONCE} SELECT query_id, query, top_k, answer_format, enable_llm_rerank, logged_at FROM once",
    "document_filter": f"""WITH {_ONCE}, {_ACTIVE}, asked AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(document_ids) = 0 THEN [NULL] ELSE document_ids END) AS doc_id FROM once WHERE document_ids IS NOT NULL),
counts AS (SELECT query_id, count(a.doc_id) AS n_valid, count(*) FILTER (q.doc_id IS NOT NULL AND a.doc_id IS NULL) AS n_missing FROM asked q LEFT JOIN active a USING (doc_id) GROUP BY query_id)
SELECT query_id, n_valid, n_missing, CASE WHEN n_valid = 0 THEN 'no_valid_documents' WHEN n_missing > 0 THEN 'some_missing' ELSE 'ok' END AS outcome FROM counts""",
    "masked_rows": f"""WITH {_LIVE}, {_ONCE} SELECT query_id, count(*) AS n_rows, min(embedding_row) AS first_row, max(embedding_row) AS last_row
FROM (SELECT DISTINCT query_id, unnest(document_ids) AS doc_id FROM once) JOIN live USING (doc_id) GROUP BY query_id""",
    "ready_rows": f"WITH {_LIVE} SELECT embedding_row AS row FROM live",
    "last_row": f"WITH {_LIVE} SELECT coalesce(max(embedding_row), -1) AS last_row FROM live",
    "doc_listing": "SELECT doc_id, filename, status, num_pages, num_chunks, ocr_pages, is_deleted, ingested_at FROM documents",
    "status_counts": "SELECT status, is_deleted, count(*) AS n, CAST(sum(num_chunks) AS BIGINT) AS chunks, CAST(sum(ocr_pages) AS BIGINT) AS ocr_pages FROM documents GROUP BY ALL",
    "dedup_sha256": """SELECT lower(sha256) AS sha256, CAST(CASE WHEN sha256 IS NULL THEN count(*) ELSE 1 END AS BIGINT) AS n, min(doc_id) AS first_doc FROM
(SELECT sha256, lower(sha256) AS h, doc_id FROM documents) WHERE h IS NULL OR h NOT IN (SELECT lower(sha256) FROM documents WHERE status = 'ready' AND is_deleted = 0 AND sha256 IS NOT NULL) GROUP BY h, sha256 IS NULL, lower(sha256)""",
    "released_rows": """SELECT doc_id, count(*) AS n, count(CASE WHEN coalesce(status, '') NOT IN ('processing', 'failed') THEN embedding_row END) AS n_rows
FROM chunks LEFT JOIN documents USING (doc_id) GROUP BY doc_id""",
    "lookups": f"""WITH {_ACTIVE} SELECT 'hash' AS by, doc_id FROM documents JOIN active USING (doc_id) WHERE lower(sha256) IN (SELECT lower(sha256) FROM documents WHERE status = 'failed' OR is_deleted = 1)
UNION ALL SELECT 'id', doc_id FROM active WHERE doc_id IN (SELECT unnest(document_ids) FROM requests)""",
    "text_hash": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "assign_rows": f"""WITH {_LIVE}, new AS (SELECT DISTINCT doc_id, ordinal FROM chunks WHERE embedding_row IS NULL)
SELECT doc_id, ordinal, (SELECT coalesce(max(embedding_row), -1) FROM live) + row_number() OVER (ORDER BY doc_id, ordinal) AS embedding_row FROM new""",
    "mark_unfinished": "SELECT CASE WHEN status IN ('processing', 'failed') THEN 'failed' ELSE status END AS status, count(*) AS n FROM documents GROUP BY 1",
    "soft_delete": """SELECT CASE WHEN doc_id % 7 = 0 AND is_deleted = 0 THEN 1 ELSE is_deleted END AS is_deleted, count(*) AS n, count(*) FILTER (deleted_at IS NOT NULL OR doc_id % 7 = 0 AND is_deleted = 0) AS dated, CAST(NULL AS BIGINT) AS missing
FROM documents GROUP BY 1 UNION ALL SELECT -1, 0, 0, count(*) FROM documents WHERE doc_id % 7 = 0 AND is_deleted <> 0""",
    "recovery": """WITH kept AS (SELECT embedding_row FROM chunk_vectors WHERE embedding_row % 10 <> 3),
lost AS (SELECT DISTINCT c.doc_id FROM chunks c JOIN documents d USING (doc_id) WHERE c.embedding_row IS NOT NULL AND d.status = 'ready' AND d.is_deleted = 0 AND c.embedding_row NOT IN (SELECT embedding_row FROM kept)),
docs AS (SELECT doc_id, is_deleted, CASE WHEN status IN ('processing', 'failed') OR doc_id IN (SELECT doc_id FROM lost) THEN 'failed' ELSE status END AS status FROM documents)
SELECT status, count(*) AS n FROM docs GROUP BY 1 UNION ALL
SELECT 'vectors', count(*) FROM kept WHERE embedding_row IN (SELECT embedding_row FROM chunks c JOIN docs d USING (doc_id) WHERE d.status = 'ready' AND d.is_deleted = 0 AND embedding_row IS NOT NULL)""",
    "evicted_rows": f"WITH {_LIVE} SELECT embedding_row AS row FROM live WHERE doc_id % 7 = 0",
    "integrity": f"""WITH {_LIVE}, kept AS (SELECT embedding_row, CASE WHEN embedding_row % 11 = 5 THEN least(len(embedding), 60) ELSE len(embedding) END AS k FROM chunk_vectors WHERE embedding_row % 10 <> 3) SELECT 'orphan_chunk' AS violation, count(*) AS n FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'status', count(*) FROM documents WHERE NOT coalesce(status IN ('processing', 'ready', 'failed'), false)
UNION ALL SELECT 'source', count(*) FROM chunks WHERE NOT coalesce(source IN ('pdf_text', 'ocr'), false)
UNION ALL SELECT 'row_twice', count(*) FROM (SELECT embedding_row FROM chunks WHERE embedding_row IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'vector_length', count(*) FROM kept WHERE coalesce(k, -1) <> 64
UNION ALL SELECT 'no_vector', count(*) FROM live WHERE embedding_row NOT IN (SELECT embedding_row FROM kept)""",
    "l2_normalize": """WITH v AS (SELECT embedding_row, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM chunk_vectors)
SELECT embedding_row, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 6) AS first FROM v""",
    "upload_validation": """WITH u AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE filename END AS filename, CASE WHEN doc_id % 4 = 0 THEN 'application/pdf' WHEN doc_id % 4 = 1 THEN 'text/plain' ELSE '' END AS kind,
  doc_id % 5 <> 0 OR starts_with(coalesce(text, ''), '%PDF-') AS pdf, strlen(coalesce(text, '')) + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 9 END AS bytes FROM documents)
SELECT doc_id, CASE WHEN length(filename) > 0 THEN filename ELSE 'unnamed.pdf' END AS filename, CASE WHEN kind = 'text/plain' THEN 'file is not a pdf' WHEN NOT pdf THEN 'not a valid PDF' WHEN bytes > 2000 THEN 'file exceeds 2000 byte limit' END AS error,
  pdf AND kind <> 'text/plain' AS candidate FROM u""",
    "ocr_plan": f"""WITH pages AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 0 THEN '  short ' ELSE max(text) END AS raw FROM chunks GROUP BY doc_id, page),
counts AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (length(regexp_replace(coalesce(raw, ''), '^{_WS}|{_WS}$', '', 'g')) < 50) AS low_pages FROM pages GROUP BY doc_id)
SELECT doc_id, pages, low_pages, CASE WHEN low_pages = 0 THEN 'none' WHEN low_pages = pages THEN 'whole' ELSE 'per_page' END AS plan FROM counts""",
}
