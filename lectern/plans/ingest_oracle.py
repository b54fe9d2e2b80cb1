"""DuckDB SQL for the queries of ``ingest_queries.py``."""

from __future__ import annotations

import hashlib

from lectern.functions import fixed
from lectern.plans import ingest_queries as Q
from lectern.plans.corpus import NOTES_SQL, STRUCTURED_SQL
from lectern.plans.oracle import chunks, few_breaks, html_text, snippet, strip
from lectern.sources.connectors import FIXTURES

_DOCS = f"""{NOTES_SQL}, docs AS (SELECT substr(sha1(owner || ':' || kind || ':doc:' || doc_id::VARCHAR), 1, 16) AS id, owner AS owner_id, 'doc:' || doc_id::VARCHAR AS external_id, kind, title, text, doc_id AS doc_seq,
  '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS created_at FROM notes)"""
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {0})"
_SHA = "length(text)::BIGINT AS n_chars, sha1(text) AS text_sha1"


def _values(rows: list[tuple], columns: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


def _picked(values: tuple, index: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{index}]"


def _uploads() -> str:
    text = f"""CASE ending WHEN '.Html' THEN {html_text("'<h2>Top</h2><p>' || text || '</p>'")} WHEN '.docx' THEN {few_breaks("'## ' || text")} WHEN '.pdf' THEN coalesce(paged, '') ELSE text END"""
    return f"""WITH d AS (SELECT doc_id, text, {_picked(Q.ENDINGS, f"doc_id % {len(Q.ENDINGS)} + 1")} AS ending FROM documents),
      pages_ AS (SELECT doc_id, i // {Q.PAGE_LINES} AS p, {few_breaks(f"regexp_replace(string_agg(line, chr(10) ORDER BY i), '[ ' || chr(9) || ']+', ' ', 'g')")} AS t FROM {_LINES.format("documents")} GROUP BY ALL),
      paged AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY p) FILTER (t <> '') AS paged FROM pages_ GROUP BY doc_id),
      n AS (SELECT 'notes ' || doc_id::VARCHAR || ending AS name, 'notes ' || doc_id::VARCHAR AS title, {text} AS text, CASE ending WHEN '.exe' THEN 'unsupported file type' WHEN '.markdown' THEN 'file is over 20 MB' END AS error FROM d JOIN paged USING (doc_id))
      SELECT name, CASE WHEN error IS NULL THEN 'upload:' || name END AS external_id, CASE WHEN error IS NULL THEN title END AS title, CASE WHEN error IS NULL THEN 'upload' END AS kind,
        CASE WHEN error IS NULL THEN length(text) END::BIGINT AS n_chars, CASE WHEN error IS NULL THEN sha1(text) END AS text_sha1, error FROM n"""


def _blocks() -> str:
    indent = "repeat('  ', i % 5)"
    apart = lambda x: f"chr(10) || {x} || chr(10)"
    forms = {
        "heading_1": apart("'# ' || line"), "heading_2": apart("'## ' || line"), "heading_3": apart("'### ' || line"), "child_page": apart("'## ' || line"), "divider": apart("'---'"),
        "bulleted_list_item": f"{indent} || '- ' || line", "numbered_list_item": f"{indent} || '1. ' || line", "to_do": f"{indent} || '- [ ] ' || line", "quote": "'> ' || line",
        "code": apart("'```' || CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE '' END || chr(10) || line || chr(10) || '```'"),
    }
    case = f"CASE {_picked(Q.BLOCK_KINDS, f'(doc_id + i) % {len(Q.BLOCK_KINDS)} + 1')} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in forms.items()) + " ELSE line END"
    return f"WITH t AS (SELECT doc_id, {few_breaks(f'string_agg({case}, chr(10) ORDER BY i)')} AS text FROM {_LINES.format('documents')} WHERE i % 5 < 4 GROUP BY doc_id) SELECT doc_id, {_SHA} FROM t"


def _paragraphs() -> str:
    level = f"regexp_extract({_picked(Q.STYLES, f'i % {len(Q.STYLES)} + 1')}, '^HEADING_([1-6])$', 1)"
    line = f"CASE WHEN {strip('line')} = '' THEN '' WHEN coalesce({level}, '') <> '' THEN repeat('#', {level}::INT) || ' ' || line ELSE line END || CASE WHEN i % 4 = 0 THEN repeat(chr(10), 3) ELSE '' END"
    return f"WITH t AS (SELECT doc_id, {few_breaks(f'string_agg({line}, chr(10) ORDER BY i)')} AS text FROM {_LINES.format('documents')} GROUP BY doc_id) SELECT doc_id, {_SHA} FROM t"


def _ingest() -> str:
    nothing = "NULL::VARCHAR"
    return f"""WITH RECURSIVE {NOTES_SQL}, {STRUCTURED_SQL},
      given AS (SELECT doc_id, title, kind, CASE WHEN doc_id % 10 = 0 THEN 'too short ' || doc_id::VARCHAR ELSE {strip("text")} END AS text FROM structured),
      long_ AS (SELECT * FROM given WHERE length(text) >= {fixed.DOCUMENT_LEAST}), {chunks("long_")},
      per AS (SELECT doc_id, count(*) AS n FROM chunked GROUP BY doc_id),
      labels_ AS (SELECT doc_id, array_to_string(list(label ORDER BY number IS NULL, number), '|') AS units FROM (SELECT DISTINCT doc_id, number, label FROM chunked) GROUP BY doc_id)
      SELECT 'doc:' || doc_id::VARCHAR AS external_id, substr(sha1('owner:' || kind || ':doc:' || doc_id::VARCHAR), 1, 16) AS id, title, kind, length(text)::BIGINT AS char_count, coalesce(n, 0)::BIGINT AS chunk_count, coalesce(units, '') AS units,
        false AS llm_enriched, '{Q.CREATED}' AS created_at, '2024-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS updated_at, {nothing} AS error FROM long_ LEFT JOIN per USING (doc_id) LEFT JOIN labels_ USING (doc_id)
      UNION ALL SELECT 'doc:' || doc_id::VARCHAR, {nothing}, {nothing}, {nothing}, NULL, NULL, {nothing}, NULL, {nothing}, {nothing}, 'document is too short' FROM given WHERE length(text) < {fixed.DOCUMENT_LEAST}"""


def _model() -> str:
    first, second = f"left(text, {Q.FIRST})", f"substr(text, {Q.FIRST + 1})"
    shown = lambda i, t: f"'[{i}] ' || title || chr(10) || {snippet(t, 700)}"
    return f"""WITH {NOTES_SQL}, p AS (SELECT *, length({shown(0, first)} || chr(10) || chr(10) || {shown(1, second)}) AS n FROM notes),
      s AS (SELECT doc_id, n, n % 3 = 2 AS answered, CASE WHEN n % 2 = 1 THEN n % 12 + 1 END AS wk, ordinal, number, title, scheme, CASE WHEN ordinal = 0 THEN doc_id % 4 = 0 ELSE doc_id % 8 = 4 END AS bare FROM p, (VALUES (0), (1)) o(ordinal)),
      m AS (SELECT *, answered AND ordinal = 0 AND wk IS NOT NULL AND (bare OR wk <> number) AS moved FROM s)
      SELECT doc_id, ordinal::BIGINT AS ordinal, CASE WHEN moved THEN CASE WHEN doc_id % 8 = 4 THEN 'Week' ELSE scheme END || ' ' || wk::VARCHAR WHEN bare THEN 'Unplaced' ELSE title END AS label,
        CASE WHEN moved OR bare THEN 'inferred' ELSE 'explicit' END AS confidence, CASE WHEN NOT answered THEN 'Mined' WHEN ordinal = 0 THEN 'Alpha|Beta|Gamma|Delta' ELSE '' END AS concepts FROM m"""


def _texts() -> str:
    heads = "CASE WHEN doc_id % 3 = 0 THEN {0} ELSE {1} END"
    whole = f"array_to_string(list_filter([{heads.format(repr(''), q_join('title', 'source'))}, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || ', Sampling' END, text], lambda x: x <> ''), chr(10))"
    shown = f"'[' || number::VARCHAR || '] ' || {heads.format(repr(''), q_join('title', 'source'))} || chr(10) || {snippet('text', 700)}"
    return f"WITH {NOTES_SQL} SELECT doc_id, sha1({whole}) AS embedding_sha1, sha1({shown}) AS outline_sha1, ceil(length(text) / 4)::BIGINT AS approx_tokens FROM notes"


def q_join(*columns: str) -> str:
    return " || ' › ' || ".join(columns)


def _shapes() -> str:
    t = strip("line")
    pattern = r"^(#{1,6})\s+(.*\S)\s*$"
    return rf"""WITH {NOTES_SQL}, {STRUCTURED_SQL}, l AS (SELECT doc_id, i, line, {t} AS t, regexp_matches(line, '{pattern}') AS marked FROM {_LINES.format("structured")})
      SELECT doc_id, i::BIGINT AS line, CASE WHEN marked THEN length(regexp_extract(line, '{pattern}', 1)) END::BIGINT AS marked_level, CASE WHEN marked THEN regexp_extract(line, '{pattern}', 2) END AS marked_text,
        length(t) BETWEEN 1 AND 60 AND len(regexp_split_to_array(t, '\s+')) <= 9 AND regexp_matches(t, '^[A-Z0-9]') AND NOT regexp_matches(t, '[.,;:!?]$') AS bare,
        CASE WHEN regexp_matches(t, '(?i)^(?:{fixed.UNIT_NAMES}|w[0-9])\b') THEN 2 ELSE 3 END::BIGINT AS bare_level FROM l"""


def _sign_in() -> str:
    mail = "'Jo.van_' || replace(c_name, '#', '-') || '@Example.org'"
    name = f"array_to_string(list_transform(list_filter(regexp_split_to_array(string_split({mail}, '@')[1], '[._-]+'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
    back = lambda made, own: f"CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '{made}' WHEN c_custkey % 7 = 2 THEN NULL ELSE {own} END"
    return f"""WITH u AS (SELECT c_custkey, substr(sha1(lower({mail})), 1, 16) AS id, {name} AS name, {mail} AS email FROM customer)
      SELECT c_custkey, id, name, email, url_encode('{{"id":"' || id || '","email":"' || email || '","name":"' || name || '"}}') AS cookie, {back("7", "id")} AS back_id, {back("Ann Lee", "name")} AS back_name, {back("ann_lee@x.org", "email")} AS back_email FROM u"""


#: What the steps of a session come to, by reading the sample notes.
_REQUESTS = [
    ("login without an address", 400, "An e-mail address is needed."),
    ("sources without a session", 401, "Not signed in"),
    ("sources with a broken session", 401, "Not signed in"),
    ("login", 200, "Jo Doe"),
    ("listing", 200, "notion-exam|notion-graphs|notion-trees"),
    ("unknown connector", 404, "Unknown connector"),
    ("sync", 200, "2, nowhere: unknown document nowhere"),
    ("sync all", 200, "3, 0"),
    ("sources", 200, "3, 7, local, False"),
    ("sources of another", 200, "0"),
    ("taxonomy", 200, "Week 1|Week 2|Week 3|Unplaced, 3, 7"),
    ("empty search", 400, "query is required"),
    ("search", 200, "Trees, Week 3, Week 3, 1, False"),
    ("search in a unit", 200, "['unit 2'], Week 2"),
    ("summary", 200, "extractive, greedy choice, Unplaced, 2"),
    ("quiz", 200, "extractive, Week 3, True, 2"),
    ("study of nothing", 200, "True"),
    ("written summary", 200, "model, Written., a|b"),
    ("quiz that the model fails", 200, "extractive"),
    ("delete what is not there", 404, "No such document"),
    ("delete", 200, "True"),
    ("taxonomy afterwards", 200, "Week 1|Week 2|Unplaced, 2"),
    ("logout", 200, "True"),
]


def oracle_sql() -> dict[str, str]:
    tail = f"right(text, {fixed.CHUNK_OVERLAP})"
    fixtures = [(i, t, s, x) for s, rows in FIXTURES.items() for i, t, x in rows]
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    trees = next(x for i, _, _, x in fixtures if i == "notion-trees")
    return {
        "upload_parse": _uploads(),
        "connector_fetch": _values([(i, t, s, len(x), sha(x), None) for i, t, s, x in fixtures], "external_id, title, kind, n_chars, text_sha1, error").replace("SELECT *", "SELECT external_id, title, kind, n_chars::BIGINT AS n_chars, text_sha1, error::VARCHAR AS error"),
        "connector_listing": _values([(i, t, s) for i, t, s, _ in fixtures], "external_id, title, kind").replace("SELECT *", "SELECT *, NULL::VARCHAR AS text, NULL::VARCHAR AS error"),
        "connector_sync": _values([("notion-trees", len(trees), None), ("nowhere", None, "unknown document nowhere")], "external_id, n_chars, error").replace("SELECT *", "SELECT external_id, n_chars::BIGINT AS n_chars, error"),
        "block_walk": _blocks(),
        "docs_paragraphs": _paragraphs(),
        "newest_documents": f"WITH {_DOCS} SELECT row_number() OVER (ORDER BY created_at DESC, doc_seq) AS rank, external_id, created_at FROM docs WHERE owner_id = 'de' ORDER BY rank LIMIT 40",
        "point_lookup": f"WITH {_DOCS} SELECT id, external_id, title FROM docs WHERE owner_id = 'en' ORDER BY doc_seq LIMIT 1",
        "reset_owner": f"""WITH {_DOCS} SELECT 'documents' AS "table", id FROM docs WHERE owner_id <> 'fr' UNION ALL SELECT 'chunks', id || ':0' FROM docs WHERE owner_id <> 'fr'
          UNION ALL SELECT 'concepts', id FROM (SELECT DISTINCT substr(sha1(owner || ':' || source), 1, 16) AS id, owner FROM notes) WHERE owner <> 'fr'""",
        "store_snapshot": f"WITH {_DOCS} SELECT id, owner_id, external_id, upper(title) AS title, length(text)::BIGINT AS char_count, title AS unit, doc_seq % 12 + 1 AS number, doc_seq FROM (SELECT * FROM docs WHERE owner_id <> 'es')",
        "library_totals": "SELECT count(*) AS document_count, coalesce(sum(doc_id % 5), 0)::BIGINT AS passages FROM documents",
        "ingest_documents": _ingest(),
        "model_enrichment": _model(),
        "embedding_texts": _texts(),
        "line_shapes": _shapes(),
        "overlap_tails": rf"SELECT doc_id, CASE WHEN length(text) <= {fixed.CHUNK_OVERLAP} THEN text WHEN regexp_matches({tail}, '[.!?]\s') THEN regexp_extract({tail}, '(?s)^(?:.*?)[.!?]\s(.*)$', 1) ELSE {tail} END AS tail FROM documents",
        "clean_newlines": f"SELECT doc_id, sha1({strip('text')}) AS text_sha1 FROM documents",
        "facet_toggle": f"WITH {NOTES_SQL} SELECT doc_id, array_to_string(CASE WHEN list_contains(c, title) THEN list_filter(c, lambda x: x <> title) ELSE list_append(c, title) END, '|') AS chosen FROM (SELECT *, ['Week 1', 'Topic 3', 'Lecture 5'] AS c FROM notes)",
        "study_scopes": _values([
            (0, "summary", "your whole library", "your whole library"), (1, "summary", "heaps", "heaps"), (2, "flashcards", "Trees, Heaps, Week 3", "Trees Heaps"), (3, "quiz", "Week 3, unit 4, unit 5", "Week 3, unit 4, unit 5"),
            (4, "summary", "sampling, Bias, Lecture 2, unit 7", "sampling"),
        ], "request, mode, scope, query").replace("SELECT *", "SELECT request::BIGINT AS request, mode, scope, query"),
        "clamped_k": _values([(0, 8), (1, 1), (2, 1), (3, 1), (4, 8), (5, 30), (6, 30), (7, 30)], "request, k").replace("SELECT *", "SELECT request::BIGINT AS request, k::BIGINT AS k"),
        "provider_choice": _values([
            (0, "local", "hashed-ngram-512", 512, False), (1, "openai", "text-embedding-3-small", 1536, True), (2, "voyage", "voyage-3", 1024, True), (3, "local", "hashed-ngram-512", 512, False),
            (4, "openai", "text-embedding-3-small", 1536, True), (5, "local", "hashed-ngram-512", 512, False), (6, "voyage", "voyage-3", 1024, True),
        ], "environment, provider, model, dimensions, semantic").replace("SELECT *", "SELECT environment::BIGINT AS environment, provider, model, dimensions::BIGINT AS dimensions, semantic"),
        "remote_embedding": "SELECT doc_id, round(length(text) / n, 6) AS x, round(100 / n, 6) AS y, 0.0::DOUBLE AS z FROM (SELECT *, sqrt(length(text)::DOUBLE * length(text) + 10000) AS n FROM documents)",
        "sign_in": _sign_in(),
        "requests": _values([(i, *r) for i, r in enumerate(_REQUESTS)], "step, request, status, answer").replace("SELECT *", "SELECT step::BIGINT AS step, request, status::BIGINT AS status, answer"),
    }
