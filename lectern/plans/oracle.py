"""DuckDB SQL for the queries of ``queries.py``, written from the semantics, not from the plans."""

from __future__ import annotations

from lectern.functions import fixed
from lectern.plans.corpus import NOTES_SQL, STRUCTURED_SQL
from lectern.plans.queries import DELETED, EVERY, ORPHANED


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STOP, CONCEPT_STOP = _list(fixed.STOPWORDS), _list(fixed.CONCEPT_STOPWORDS)


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def raw(col: str) -> str:
    return f"regexp_extract_all(lower({col}), {q(fixed.RAW_WORD)})"


def tokens(col: str) -> str:
    keep = f"length(x) > 2 AND NOT list_contains({STOP}, x)"
    mark = q("['’-]")
    return f"""flatten(list_transform({raw(col)}, lambda w: CASE
      WHEN regexp_matches(w, {mark}) THEN list_concat(list_filter([regexp_replace(w, {mark}, '', 'g')], lambda x: length(x) > 2), list_filter(regexp_split_to_array(w, {mark}), lambda x: {keep}))
      ELSE list_filter([w], lambda x: {keep}) END))"""


def collapse(col: str) -> str:
    return rf"regexp_replace({col}, '\s+', ' ', 'g')"


def snippet(col: str, n: int) -> str:
    c = f"trim({collapse(col)})"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n - 1}) || '…' END"


def lead(col: str) -> str:
    found = f"regexp_extract({collapse(col)}, {q(fixed.LEAD_SENTENCE)})"
    return f"trim(CASE WHEN {found} = '' THEN {snippet(col, 200)} ELSE {found} END)"


def title_case(expr: str) -> str:
    cap = "upper(left(lower(w), 1)) || substr(lower(w), 2)"
    return f"array_to_string(list_transform(regexp_split_to_array({expr}, '\\s+'), lambda w, i: CASE WHEN regexp_matches(substr(w, 2), '[A-Z]') THEN w WHEN i > 1 AND list_contains({STOP}, lower(w)) THEN lower(w) ELSE {cap} END), ' ')"


def normal(expr: str) -> str:
    s = rf"regexp_replace(lower({expr}), '[''’]s\b', '', 'g')"
    s = rf"trim(regexp_replace(regexp_replace({s}, '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"
    return rf"regexp_replace({s}, '(\w)s$', '\1')"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def few_breaks(expr: str) -> str:
    """Three line ends or more as two, and none at the ends."""
    return strip(rf"regexp_replace({expr}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def html_text(s: str = "html") -> str:
    for tag in ("script", "style"):
        s = rf"regexp_replace({s}, '<{tag}.*?</{tag}>', '', 'gis')"
    s = rf"regexp_replace({s}, '</(?:p|div|li|tr|h[1-6])>', chr(10), 'gi')"
    s = rf"regexp_replace({s}, '<br\s*/?>', chr(10), 'gi')"
    for level in range(1, 7):
        s = f"regexp_replace({s}, '<h{level}[^>]*>', chr(10) || '{'#' * level} ', 'gi')"
    s = f"regexp_replace({s}, '<[^>]+>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&quot;", '"')):
        s = f"replace({s}, '{entity}', '{char}')"
    return few_breaks(s)


def _unit_numbers(col: str) -> dict[tuple[str, int], list[str]]:
    """Per scheme, list expressions of its numbers in a text."""
    out: dict[tuple[str, int], list[str]] = {}
    for scheme, priority, name in fixed.UNIT_SCHEMES:
        pattern = r"\bw(\d{1,2})(?:[\s:.\-–—]|$)" if name == "w" else rf"\b{name}{fixed.UNIT_GAP}(\d{{1,2}})\b"
        out.setdefault((scheme, priority), []).append(f"regexp_extract_all({col}, {q('(?i)' + pattern)}, 1)")
    return out


INTRO = "title || chr(10) || 'see w' || number::VARCHAR || ': and Chapter ' || (number + 1)::VARCHAR || ', lab - 3' || chr(10) || text"


def _markers() -> str:
    parts = [
        f"SELECT doc_id, '{scheme}' AS scheme, {priority} AS priority, unnest({e})::BIGINT AS number FROM intro" for (scheme, priority), found in _unit_numbers("t").items() for e in found
    ]
    return f"{NOTES_SQL}, intro AS (SELECT doc_id, {INTRO} AS t FROM notes), markers AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE number BETWEEN 1 AND 52)"


def _intent() -> str:
    asked = f"'Week ' || (item_id % {12} + 1)::VARCHAR || ' and w3: ' || text"
    # the first marker stands at the start, the second right after it; the passages hold none
    phrase = q(rf"(?i)\b(?:{fixed.UNIT_NAMES}){fixed.UNIT_GAP}\d{{1,2}}\b")
    cleaned = f"trim({collapse(f'regexp_replace(a, {phrase}, chr(32), chr(103))')})"
    return f"""WITH b AS (SELECT item_id, {asked} AS a FROM benchmark)
      SELECT item_id, CASE WHEN item_id % 12 + 1 = 3 THEN '3' ELSE (item_id % 12 + 1)::VARCHAR || '|3' END AS week_numbers,
             CASE WHEN length({cleaned}) < 3 THEN a ELSE {cleaned} END AS cleaned FROM b"""


_ASOF = """WITH blocks AS (SELECT doc_id, b * 150 AS "offset" FROM documents, range(0, 10) r(b)),
  given AS (SELECT doc_id, b * 370 + doc_id % 7 * 20 - 40 AS idx, b + 1 AS number FROM documents, range(0, 4) r(b) WHERE b <= doc_id % 4),
  markers AS (SELECT * FROM given WHERE idx >= 0 UNION ALL SELECT doc_id, -1, arg_min(number, idx) FROM given WHERE idx < 0 GROUP BY doc_id)
  SELECT b.doc_id, b."offset"::BIGINT AS "offset", CASE WHEN m.number IS NULL THEN 'Unplaced' ELSE 'Week ' || m.number::VARCHAR END AS label,
         CASE WHEN m.number IS NULL THEN 'inferred' WHEN m.idx >= 0 AND m.idx >= b."offset" - 200 THEN 'explicit' ELSE 'inherited' END AS confidence
  FROM blocks b ASOF LEFT JOIN markers m ON b.doc_id = m.doc_id AND m.idx <= b."offset" """

_FNV = f"""WITH w AS (SELECT DISTINCT unnest({raw("text")}) AS word FROM documents),
  h AS (SELECT word, list_reduce(list_concat([{fixed.FNV_SEED ^ fixed.WORD_SALT}::BIGINT], list_transform(string_split(word, ''), lambda c: ord(c)::BIGINT)),
        lambda a, c: (xor(a, c) * {fixed.FNV_PRIME}) & 4294967295) AS hash FROM w)
  SELECT word, hash, hash % {fixed.DIMENSIONS} AS bucket, CASE WHEN hash >> 31 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM h"""

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_DENSE = f"""dense AS (SELECT b.vec_id AS query_id, a.vec_id AS seq, a.label::VARCHAR AS document_id, round({_DOT}, 6) AS score
  FROM embeddings a, embeddings b WHERE b.vec_id % {EVERY} = 0)"""

_SCALE = "CASE WHEN max({0}) OVER w - min({0}) OVER w < 1e-9 THEN CASE WHEN max({0}) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"

_LABELS = """labels_ AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS embedding FROM (SELECT label, list(x ORDER BY i) AS v FROM
  (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label))"""
_CONCEPT = f"""{_LABELS}, scored AS (SELECT b.vec_id AS query_id, 'Topic label ' || a.label::VARCHAR AS name, a.label, {_DOT} AS score FROM labels_ a, embeddings b WHERE b.vec_id % {EVERY} = 0)"""


def _bm25(texts: str, questions: str, where: str) -> str:
    """CTEs tok, terms, qt, cand, bm25(query_id, doc_id, s); ``texts``: view of (doc_id, lex); ``questions``: view of (query_id, text)."""
    return f"""tok AS (SELECT *, {tokens("lex")} AS t FROM {texts}),
  terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
  qt AS (SELECT query_id, unnest(list_distinct({tokens("text")})) AS term FROM {questions}),
  cand AS (SELECT query_id, tok.doc_id, len(t) AS l FROM tok, {questions} WHERE {where}),
  stats AS (SELECT query_id, count(*) AS n, avg(l) AS mean FROM cand GROUP BY query_id),
  hits AS (SELECT query_id, doc_id, term, tf, l FROM terms JOIN qt USING (term) JOIN cand USING (query_id, doc_id)),
  df AS (SELECT query_id, term, count(*) AS df FROM hits GROUP BY ALL),
  bm25 AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / CASE WHEN mean > 0 THEN mean ELSE 1 END))) AS s
    FROM hits JOIN df USING (query_id, term) JOIN stats USING (query_id) GROUP BY ALL)"""


_QUESTIONS = f"questions AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % {EVERY} = 0)"
_ALL_QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"
_GROUP = "substr(sha1(owner || ':' || source), 1, 16)"


def _hybrid(where: str, k: int, weights: dict[str, float] = fixed.LOCAL_WEIGHTS, name: str = "ranked", questions: str = _QUESTIONS) -> str:
    """CTEs down to ``name``: query_id, seq, document columns, raw and final scores, rank. Notes without an embedding row have no concept and a zero vector."""
    fused = " + ".join(f"{w} * ({_SCALE.format(c)})" for c, w in weights.items())
    return f"""{NOTES_SQL}, {questions}, {_LABELS},
  base AS (SELECT n.*, e.embedding, e.label, {_GROUP} AS document_id, n.title || coalesce(' Topic label ' || e.label::VARCHAR, '') || ' ' || n.text AS lex FROM notes n LEFT JOIN embeddings e ON n.doc_id = e.vec_id),
  docs_ AS (SELECT {_GROUP} AS document_id, min(kind) AS doc_kind, any_value(source) AS doc_title FROM notes GROUP BY 1),
  placed AS (SELECT base.*, doc_kind, doc_title FROM base JOIN docs_ USING (document_id)),
  {_bm25("placed", "questions", where)},
  vec AS (SELECT query_id, embedding FROM questions JOIN embeddings ON vec_id = query_id),
  chan AS (SELECT c.query_id, c.doc_id AS seq, coalesce((SELECT {_DOT} FROM vec b WHERE b.query_id = c.query_id), 0.0) AS dense, coalesce(bm25.s, 0.0) AS lexical,
      coalesce((SELECT greatest(0.0, list_sum(list_transform(list_zip(l.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))) FROM vec b, labels_ l WHERE b.query_id = c.query_id AND l.label = a.label), 0.0) AS concept,
      a.document_id, a.doc_title, a.doc_kind, a.number, a.title, a.text, a.label
    FROM cand c JOIN placed a ON a.doc_id = c.doc_id LEFT JOIN bm25 ON bm25.query_id = c.query_id AND bm25.doc_id = c.doc_id),
  fused AS (SELECT *, {fused} AS f FROM chan WINDOW w AS (PARTITION BY query_id)),
  nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY f DESC, seq) - 1 AS k FROM fused),
  {name} AS (SELECT * FROM (SELECT *, f / (1 + {fixed.DIVERSITY} * k) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f / (1 + {fixed.DIVERSITY} * k) DESC, f DESC, seq) AS rank FROM nth) WHERE rank <= {k})"""


def _mined(where: str = "true") -> str:
    ok = lambda w: f"length({w}) >= 4 AND NOT list_contains({STOP}, lower({w})) AND NOT list_contains({CONCEPT_STOP}, lower({w})) AND NOT (ends_with(lower({w}), 'ly') AND length({w}) > 5)"
    heading = title_case("upper(left(source, 1)) || substr(source, 2) || ' notes'")
    return f"""{NOTES_SQL},
  sw AS (SELECT doc_id, regexp_extract_all(text, {q(fixed.SURFACE_WORD)}) AS w FROM notes),
  pr AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM sw)),
  cnt AS (SELECT doc_id, lower(a || ' ' || b) AS pair, count(*) AS n, arg_min(a || ' ' || b, i) AS surface FROM pr WHERE {ok("a")} AND {ok("b")} GROUP BY ALL),
  head AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN {heading} END AS h FROM notes),
  best AS (SELECT doc_id, list({title_case("surface")} ORDER BY r) AS pairs FROM (SELECT c.*, h, row_number() OVER (PARTITION BY c.doc_id ORDER BY n DESC, pair) AS r FROM cnt c JOIN head USING (doc_id) WHERE n >= 2 AND NOT contains(lower(coalesce(h, '')), string_split(pair, ' ')[1])) WHERE r <= CASE WHEN h IS NULL THEN 2 ELSE 1 END GROUP BY doc_id),
  mined AS (SELECT n.*, {_GROUP} AS document_id, list_concat(CASE WHEN h IS NULL THEN [] ELSE [h] END, coalesce(pairs, [])) AS concepts FROM notes n JOIN head USING (doc_id) LEFT JOIN best USING (doc_id) WHERE {where})"""


def _index(where: str = "true") -> str:
    return f"""{_mined(where)},
  each AS (SELECT owner, doc_id, document_id, title, source, unnest(concepts) AS concept, generate_subscripts(concepts, 1) AS pos FROM mined),
  keyed AS (SELECT *, {normal("concept")} AS key FROM each),
  ctx AS (SELECT owner, key, doc_id, pos, source || ': ' || title AS c, row_number() OVER (PARTITION BY owner, key ORDER BY doc_id, pos) AS r FROM keyed WHERE key <> ''),
  ctx3 AS (SELECT owner, key, list(c ORDER BY r) AS cs FROM ctx WHERE r <= 3 GROUP BY ALL),
  first_ AS (SELECT owner, key, cs, list_filter(cs, lambda x, i: list_position(cs, x) = i) AS ds FROM ctx3),
  idx AS (SELECT substr(sha1(owner || ':' || key), 1, 16) AS id, owner AS owner_id, key, arg_min(concept, doc_id * 10 + pos) AS name, list(document_id || ':' || doc_id::VARCHAR ORDER BY doc_id, pos) AS chunk_ids,
      list_sort(list(DISTINCT document_id)) AS document_ids, list_sort(list(DISTINCT title)) AS week_labels FROM keyed WHERE key <> '' GROUP BY owner, key)"""


_META = f"""WITH {NOTES_SQL}, {_QUESTIONS}, {_LABELS},
  ways AS (SELECT * FROM (VALUES (0, false, []::VARCHAR[], []::INTEGER[]), (1, false, ['Topic 3'], [4]), (2, true, [], []), (3, true, [], [3])) w(way, named, weeks, numbers)),
  asked AS (SELECT query_id * 10 + way AS query_id, query_id AS vec_id, trim({collapse("text")}) AS cleaned, weeks, CASE WHEN len(weeks) + len(numbers) > 0 THEN numbers WHEN named THEN [4] ELSE [] END AS numbers FROM questions, ways),
  left_ AS (SELECT query_id, doc_id FROM asked, notes n WHERE CASE WHEN len(weeks) > 0 THEN list_contains(weeks, n.title) ELSE len(numbers) = 0 OR list_contains(numbers, n.number) END),
  st AS (SELECT query_id, bool_or(doc_id % 24 = 15) AS stale FROM left_ GROUP BY query_id),
  vec AS (SELECT query_id, embedding FROM asked JOIN st USING (query_id) JOIN embeddings e ON e.vec_id = asked.vec_id WHERE NOT stale),
  scored AS (SELECT b.query_id, 'Topic label ' || a.label::VARCHAR AS name, {_DOT} AS score FROM labels_ a, vec b),
  best AS (SELECT query_id, array_to_string(list(name ORDER BY r), '|') AS matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS r FROM scored WHERE score > {fixed.CONCEPT_THRESHOLD}) WHERE r <= {fixed.MATCHED_CONCEPTS} GROUP BY query_id)
  SELECT query_id, cleaned, CASE WHEN len(weeks) > 0 THEN array_to_string(weeks, '|') ELSE array_to_string(list_transform(numbers, lambda n: 'unit ' || n::VARCHAR), '|') END AS applied_weeks, coalesce(stale, false) AS stale_index, coalesce(matched, '') AS matched
  FROM asked LEFT JOIN st USING (query_id) LEFT JOIN best USING (query_id)"""


def _candidates() -> str:
    group = lambda owner, source: f"substr(sha1('{owner}:{source}'), 1, 16)"
    tests = [
        "true", "title IN ('Week 4', 'Topic 3')", "number IN (5, 9)", f"document_id IN ({group('en', 'src1')}, {group('de', 'src2')}, {group('fr', ORPHANED)})", "label IN (3, 7)", "doc_kind = 'gdocs'", "number = 5", "title = 'Topic 3'",
        "number IN (1, 4) AND label IN (1, 2) AND doc_kind IN ('upload', 'notion')",
    ]
    each = " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, doc_id AS seq FROM placed WHERE {t}" for i, t in enumerate(tests))
    return f"""WITH {NOTES_SQL}, base AS (SELECT n.*, {_GROUP} AS document_id, e.label FROM notes n LEFT JOIN embeddings e ON n.doc_id = e.vec_id),
      docs_ AS (SELECT document_id, min(kind) AS doc_kind, any_value(source) AS doc_title FROM base GROUP BY 1), placed AS (SELECT base.*, doc_kind FROM base JOIN docs_ USING (document_id) WHERE doc_title <> '{ORPHANED}') {each}"""


def _embedding() -> str:
    """Hashed features, each distinct one hashed once."""
    return f"""WITH d AS (SELECT doc_id, {raw("text")} AS w, {tokens("text")} AS t FROM documents),
      terms AS (SELECT doc_id, unnest(t) AS term FROM d),
      f AS (SELECT doc_id, feature, salt, weight, count(*) AS n FROM (
        SELECT doc_id, term AS feature, {fixed.WORD_SALT} AS salt, {fixed.WORD_WEIGHT}::DOUBLE AS weight FROM terms
        UNION ALL SELECT doc_id, substr('^' || term || '$', i, 4), {fixed.GRAM_SALT}, {fixed.GRAM_WEIGHT}::DOUBLE FROM (SELECT doc_id, term, unnest(range(1, length(term))) AS i FROM terms)
        UNION ALL SELECT doc_id, w[i] || '~' || w[i + 1], {fixed.PAIR_SALT}, {fixed.PAIR_WEIGHT}::DOUBLE FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)) GROUP BY ALL),
      h AS (SELECT feature, salt, list_reduce(list_concat([xor({fixed.FNV_SEED}, salt)::BIGINT], list_transform(string_split(feature, ''), lambda c: ord(c)::BIGINT)), lambda a, c: (xor(a, c) * {fixed.FNV_PRIME}) & 4294967295) AS hash FROM (SELECT DISTINCT feature, salt FROM f)),
      s AS (SELECT doc_id, hash % {fixed.DIMENSIONS} AS bucket, round(sum(CASE WHEN hash >> 31 = 1 THEN -weight * n ELSE weight * n END), 6) AS v FROM f JOIN h USING (feature, salt) GROUP BY ALL),
      g AS (SELECT doc_id, bucket, sign(v) * ln(1 + abs(v)) AS x FROM s WHERE v <> 0)
      SELECT doc_id, bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM g"""


def _overlap(x: str) -> str:
    tail = f"right({x}, {fixed.CHUNK_OVERLAP})"
    return f"CASE WHEN length({x}) <= {fixed.CHUNK_OVERLAP} THEN {x} WHEN regexp_matches({tail}, '[.!?]\\s') THEN regexp_extract({tail}, '(?s)^(?:.*?)[.!?]\\s(.*)$', 1) ELSE {tail} END"


def marker_rows(src: str) -> str:
    """CTEs mk (doc_id, scheme, priority, number, pos) and canon (doc_id, scheme): unit markers of title and text, at offsets in the text."""
    names = "|".join(n for *_, n in fixed.UNIT_SCHEMES if n != "w")
    pattern = q(rf"(?i)\b(?:(?:{names}){fixed.UNIT_GAP}\d{{1,2}}\b|w\d{{1,2}}(?:[\s:.\-–—]|$))")
    word = "lower(regexp_extract(v, '^[A-Za-z]+'))"
    schemes = [(n.removeprefix("(?:").removesuffix(")").split("|"), s, p) for s, p, n in fixed.UNIT_SCHEMES]
    case = lambda pick: "CASE " + " ".join(f"WHEN list_contains({_list(n)}, {word}) THEN {pick(s, p)}" for n, s, p in schemes) + " END"
    low, high = fixed.UNIT_NUMBERS
    return f"""mk AS (SELECT doc_id, {case(lambda s, p: f"'{s}'")} AS scheme, {case(lambda s, p: p)} AS priority, regexp_extract(v, '([0-9]+)[^0-9]*$', 1)::INTEGER AS number, pos FROM (
        SELECT doc_id, v[i] AS v, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[:i - 1], lambda x: length(x))), 0))::BIGINT - shift AS pos FROM (
          SELECT doc_id, v, g, shift, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, length(title) + 1 AS shift, regexp_extract_all(title || chr(10) || text, {pattern}) AS v, regexp_split_to_array(title || chr(10) || text, {pattern}) AS g FROM {src})))
        WHERE regexp_extract(v, '([0-9]+)[^0-9]*$', 1)::INTEGER BETWEEN {low} AND {high}),
      canon AS (SELECT doc_id, arg_max(scheme, n * 100 - priority) AS scheme FROM (SELECT doc_id, scheme, priority, count(DISTINCT number) AS n FROM mk GROUP BY ALL) GROUP BY doc_id)"""


def chunks(src: str) -> str:
    """CTEs down to chunked (doc_id, ordinal, text, headings, number, label, confidence), for WITH RECURSIVE; ``src``: view of (doc_id, title, text).

    Lines are headings, body or blank; a line that only looks like a heading is one unless a body line goes before it. The trail of a section has, of
    each level, the last heading, if none of a higher rank came after it. Paragraphs and their sentences are events that the recursion takes one by one in all sections pos once.
    """
    units = fixed.UNIT_NAMES
    target, most = fixed.CHUNK_TARGET, fixed.CHUNK_MAX
    trails = ", ".join(f"last_value(CASE WHEN level <= {k} THEN {{'l': level, 't': head}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e{k}" for k in range(1, 7))
    alive = "list_concat(" + ", ".join(f"CASE WHEN e{k}.l = {k} THEN [e{k}.t] ELSE [] END" for k in range(1, 7)) + ")"
    sentence = q(fixed.SENTENCE.replace(r"\z", "$"))
    big, full = f"kind = 'P' AND length(joined) > {most}", f"kind = 'P' AND length(joined) >= {target}"
    over = f"kind = 'S' AND big AND held <> '' AND length(held) + length(text) > {most}"
    return rf"""lines AS (SELECT doc_id, i, line, {strip("line")} AS t, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {src})),
      shapes AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+.*\S\s*$') AS marked, length(t) BETWEEN 1 AND 60 AND len(regexp_split_to_array(t, '\s+')) <= 9 AND regexp_matches(t, '^[A-Z0-9]') AND NOT regexp_matches(t, '[.,;:!?]$') AS bare FROM lines),
      bodies AS (SELECT *, coalesce(last_value(CASE WHEN marked OR t = '' THEN 0 WHEN bare THEN NULL ELSE 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS body FROM shapes),
      heads AS (SELECT *, marked OR (bare AND body = 0) AS heading FROM bodies),
      secs AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec, sum(1 - body) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM heads),
      levels AS (SELECT doc_id, sec, CASE WHEN marked THEN length(regexp_extract(line, '^(#+)', 1)) WHEN regexp_matches(t, '(?i)^(?:{units}|w[0-9])') THEN 2 ELSE 3 END AS level,
        CASE WHEN marked THEN regexp_extract(line, '^#{{1,6}}\s+(.*\S)\s*$', 1) ELSE t END AS head FROM secs WHERE heading),
      trails AS (SELECT doc_id, sec, {alive} AS headings FROM (SELECT doc_id, sec, {trails} FROM levels)),
      paras AS (SELECT doc_id, sec, g, {strip("string_agg(line, chr(10) ORDER BY i)")} AS text, min(pos) AS pos FROM secs WHERE body = 1 GROUP BY doc_id, sec, g),
      sents AS (SELECT doc_id, sec, g, pos, CASE WHEN len(s) = 0 THEN [text] ELSE s END AS s FROM (SELECT *, regexp_extract_all(text, {sentence}) AS s FROM paras)),
      ev AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY g, j) AS n FROM (
        SELECT doc_id, sec, g, 0 AS j, 'P' AS kind, text, pos FROM paras
        UNION ALL SELECT doc_id, sec, g, generate_subscripts(s, 1), 'S', unnest(s), pos FROM sents
        UNION ALL SELECT doc_id, sec, max(g) + 1, 0, 'E', '', 0 FROM paras GROUP BY doc_id, sec)),
      pack AS (SELECT doc_id, sec, 0::BIGINT AS n, ''::VARCHAR AS held, 0::BIGINT AS pos, false AS big, NULL::VARCHAR AS out, NULL::BIGINT AS out_pos FROM (SELECT DISTINCT doc_id, sec FROM paras)
        UNION ALL SELECT doc_id, sec, n,
          CASE WHEN {big} THEN '' WHEN {full} THEN {_overlap("joined")} WHEN kind = 'P' THEN joined WHEN {over} THEN ({_overlap("held")}) || text WHEN kind = 'S' AND big THEN held || text ELSE held END,
          CASE WHEN {big} THEN pat WHEN {full} THEN pat + length(text) ELSE pos END,
          CASE WHEN kind = 'P' THEN length(joined) > {most} ELSE big END,
          CASE WHEN {big} THEN nullif(held, '') WHEN {full} THEN joined WHEN {over} THEN held WHEN kind = 'E' THEN nullif(held, '') END,
          CASE WHEN {over} THEN pat ELSE pos END
        FROM (SELECT ev.doc_id, ev.sec, ev.n, ev.kind, ev.text, ev.pos AS pat, p.held, p.big, CASE WHEN ev.kind = 'P' AND p.held = '' THEN ev.pos ELSE p.pos END AS pos, CASE WHEN p.held = '' THEN ev.text ELSE p.held || chr(10) || chr(10) || ev.text END AS joined
          FROM pack p JOIN ev ON ev.doc_id = p.doc_id AND ev.sec = p.sec AND ev.n = p.n + 1)),
      kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, n) - 1 AS ordinal, sec, text, out_pos FROM (SELECT *, {strip("out")} AS text FROM pack WHERE out IS NOT NULL) WHERE length(text) >= {fixed.CHUNK_LEAST}),
      {marker_rows(src)},
      own AS (SELECT mk.* FROM mk JOIN canon USING (doc_id, scheme)),
      units AS (SELECT k.doc_id, k.ordinal, max(o.pos) FILTER (o.pos >= 0 AND o.pos <= out_pos) AS last_pos, arg_max(o.number, o.pos) FILTER (o.pos >= 0 AND o.pos <= out_pos) AS last_number, arg_min(o.number, o.pos) FILTER (o.pos < 0) AS first_number FROM kept k LEFT JOIN own o USING (doc_id) GROUP BY ALL),
      chunked AS (SELECT doc_id, ordinal, text, coalesce(headings, []) AS headings, coalesce(last_number, first_number) AS number,
        CASE WHEN coalesce(last_number, first_number) IS NULL THEN 'Unplaced' ELSE scheme || ' ' || coalesce(last_number, first_number)::VARCHAR END AS label,
        CASE WHEN coalesce(last_number, first_number) IS NULL THEN 'inferred' WHEN last_pos >= out_pos - {fixed.EXPLICIT_WITHIN} THEN 'explicit' ELSE 'inherited' END AS confidence
        FROM kept JOIN units USING (doc_id, ordinal) LEFT JOIN trails USING (doc_id, sec) LEFT JOIN canon USING (doc_id))"""


def _batch() -> str:
    return f"""{NOTES_SQL}, docs AS (SELECT substr(sha1(owner || ':' || kind || ':doc:' || doc_id::VARCHAR), 1, 16) AS id, owner AS owner_id, 'doc:' || doc_id::VARCHAR AS external_id, kind, title, doc_id AS doc_seq FROM notes),
  again AS (SELECT substr(sha1(owner || ':gdocs:doc:' || doc_id::VARCHAR), 1, 16) AS id, owner AS owner_id, 'doc:' || doc_id::VARCHAR AS external_id, 'gdocs' AS kind, 'again ' || title AS title, doc_id AS doc_seq FROM notes WHERE doc_id % 7 = 0),
  kept AS (SELECT * FROM docs WHERE (owner_id, external_id) NOT IN (SELECT (owner_id, external_id) FROM again)),
  top AS (SELECT coalesce(max(doc_seq) + 1, 0) AS t FROM kept)"""


def oracle_sql() -> dict[str, str]:
    k = fixed.TOP_K
    mail = "' Jo.van_' || replace(c_name, '#', '-') || '@Example.org '"
    name = "regexp_extract(url, '[^/]*$') || ['.PDF', '.docx', '.md', '.exe', ''][page_id % 5 + 1]"
    mined, index = _mined(), _index()
    facet = f"""{index}, canon AS (SELECT {normal("name")} AS key, max(name) AS name FROM idx GROUP BY 1),
      named AS (SELECT DISTINCT title AS label, coalesce(canon.name, concept) AS concept FROM keyed LEFT JOIN canon USING (key))"""
    placed = "number IN (3, 7, 12) AND doc_kind IN ('upload', 'notion')"
    return {
        "html_strip": f"SELECT page_id, {html_text()} AS text FROM pages",
        "raw_words": f"SELECT doc_id, len({raw('text')})::BIGINT AS n_words, len(list_distinct({raw('text')}))::BIGINT AS n_distinct FROM documents",
        "token_counts": f"WITH t AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term",
        "text_summaries": f"SELECT doc_id, {snippet('text', 240)} AS snippet, ceil(length(text) / 4)::BIGINT AS approx_tokens, {lead('text')} AS lead FROM documents",
        "sentence_split": f"WITH s AS (SELECT doc_id, regexp_extract_all(text, {q(fixed.SENTENCE.replace(chr(92) + 'z', '$'))}) AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM s",
        "unit_markers": f"WITH {_markers()} SELECT doc_id, scheme, number, count(*) AS n FROM markers GROUP BY ALL",
        "canonical_scheme": f"WITH {_markers()}, c AS (SELECT doc_id, scheme, priority, count(DISTINCT number) AS n FROM markers GROUP BY ALL) SELECT doc_id, arg_max(scheme, n * 100 - priority) AS scheme FROM c GROUP BY doc_id",
        "query_intent": _intent(),
        "unit_asof": _ASOF,
        "document_ids": f"WITH {_batch()} SELECT doc_seq AS doc_id, id AS document_id, id || ':0' AS chunk_id FROM docs",
        "owner_ids": f"SELECT c_custkey, substr(sha1(lower(trim({mail}))), 1, 16) AS owner_id, array_to_string(list_transform(list_filter(regexp_split_to_array(string_split(trim({mail}), '@')[1], '[._-]+'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS name, regexp_matches(trim({mail}), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS valid FROM customer",
        "upload_gate": f"WITH p AS (SELECT page_id, {name} AS name FROM pages) SELECT page_id, regexp_matches(lower(name), '\\.(pdf|docx|md|markdown|txt|html|htm)$') AS supported, regexp_replace(name, '\\.[^.]+$', '') AS title FROM p",
        "fnv_hash": _FNV,
        "dense_topk": f"WITH {_DENSE} SELECT query_id, seq, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM dense) WHERE rank <= {k}",
        "minmax_scale": f"WITH {_DENSE} SELECT query_id, seq, round({_SCALE.format('score')}, 6) AS scaled FROM dense WINDOW w AS (PARTITION BY query_id)",
        "diversity_topk": f"""WITH {_DENSE}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, seq) - 1 AS k FROM dense),
          r AS (SELECT *, score / (1 + {fixed.DIVERSITY} * k) AS s, row_number() OVER (PARTITION BY query_id ORDER BY score / (1 + {fixed.DIVERSITY} * k) DESC, score DESC, seq) AS rank FROM n)
          SELECT query_id, seq, document_id, rank, round(s, 6) AS score FROM r WHERE rank <= {k}""",
        "concept_channel": f"WITH {_CONCEPT} SELECT query_id, vec_id AS seq, round(greatest(score, 0.0), 6) AS concept FROM scored JOIN embeddings USING (label)",
        "matched_concepts": f"WITH {_CONCEPT} SELECT query_id, array_to_string(list(name ORDER BY r), '|') AS matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS r FROM scored WHERE score > {fixed.CONCEPT_THRESHOLD}) WHERE r <= {fixed.MATCHED_CONCEPTS} GROUP BY query_id",
        "bm25_topk": f"WITH {_QUESTIONS}, plain AS (SELECT doc_id, text AS lex FROM documents), {_bm25('plain', 'questions', 'true')}, r AS (SELECT query_id, doc_id AS seq, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM bm25) SELECT query_id, seq, rank, score FROM r WHERE rank <= {k}",
        "hybrid_fusion": f"WITH {_hybrid('true', k)} SELECT query_id, seq, doc_title AS title, round(score, 6) AS score, round(dense, 6) AS dense, round(lexical, 6) AS lexical, round(concept, 6) AS concept FROM ranked",
        "filtered_search": f"WITH {_hybrid(placed, fixed.MAX_K)} SELECT query_id, seq, title AS label, doc_kind AS kind, round(score, 6) AS score FROM ranked",
        "concept_bigrams": f"WITH {mined} SELECT doc_id, array_to_string(concepts, '|') AS concepts FROM mined",
        "concept_index": f"WITH {index} SELECT id, owner_id, name, trim(name || '. Appears in: ' || array_to_string(ds, '; ')) AS description, array_to_string(chunk_ids, '|') AS chunk_ids, array_to_string(document_ids, '|') AS document_ids, array_to_string(week_labels, '|') AS week_labels FROM idx JOIN first_ ON first_.owner = owner_id AND first_.key = idx.key",
        "unit_rollup": f"WITH {NOTES_SQL}, w AS (SELECT {_GROUP} AS document_id, number, title, doc_id % 3 AS rank, doc_id FROM notes) SELECT document_id, number::BIGINT AS number, arg_min(title, rank * 1000000000 + doc_id) AS label, ['explicit', 'inherited', 'inferred'][min(rank) + 1] AS confidence FROM w GROUP BY document_id, number",
        "concept_rollup": f"WITH {index}, f AS (SELECT document_id, arg_min(concept, doc_id * 10 + pos) AS c FROM each GROUP BY document_id, lower(concept)), l AS (SELECT document_id, list(c ORDER BY lower(c)) AS c FROM f GROUP BY document_id) SELECT document_id, array_to_string(c, '|') AS concepts, array_to_string(c[:10], '|') AS shown, greatest(len(c) - 10, 0)::BIGINT AS more FROM l",
        "taxonomy_units": f"WITH {facet} SELECT row_number() OVER (ORDER BY string_split(title, ' ')[1], any_value(number)) AS position, (SELECT array_to_string(list(concept ORDER BY lower(concept), concept)[:5], '|') FROM named WHERE named.label = mined.title) AS first_concepts, title AS label, any_value(number)::BIGINT AS number, count(*) AS chunk_count, count(DISTINCT document_id) AS document_count, (SELECT count(*) FROM named WHERE named.label = mined.title) AS n_concepts FROM mined GROUP BY title",
        "taxonomy_concepts": f"WITH {index} SELECT name, sum(len(chunk_ids))::BIGINT AS chunk_count, sum(len(document_ids))::BIGINT AS document_count FROM idx GROUP BY name",
        "concept_top": f"WITH {index} SELECT row_number() OVER (ORDER BY len(chunk_ids) DESC, lower(name), name) AS rank, name, len(chunk_ids)::BIGINT AS chunk_count, len(document_ids)::BIGINT AS document_count FROM idx WHERE owner_id = 'en' ORDER BY rank LIMIT 40",
        "unit_sidebar": f"WITH {index} SELECT name, len(chunk_ids)::BIGINT AS chunk_count FROM idx WHERE owner_id = 'en' AND list_contains(week_labels, 'Week 4')",
        "owner_concepts": f"WITH {index} SELECT id, owner_id, name FROM idx WHERE owner_id = 'fr'",
        "corpus_totals": f"WITH {NOTES_SQL} SELECT count(DISTINCT {_GROUP}) AS document_count, count(*) AS chunk_count FROM notes",
        "owner_chunks": f"WITH {_batch()} SELECT id AS document_id, doc_seq AS doc_id, kind FROM docs WHERE owner_id = 'de'",
        "upsert_docs": f"WITH {_batch()} SELECT * FROM kept UNION ALL SELECT id, owner_id, external_id, kind, title, t + doc_seq FROM again, top",
        "upsert_chunks": f"WITH {_batch()} SELECT id || ':0' AS id, id AS document_id, title FROM (SELECT id, title FROM kept UNION ALL SELECT id, title FROM again)",
        "delete_cascade": f"""WITH {index}, gone AS (SELECT DISTINCT {_GROUP} AS document_id FROM notes WHERE source IN {DELETED}),
          lost AS (SELECT list(document_id) AS g FROM gone),
          cut AS (SELECT id, list_filter(chunk_ids, lambda c: NOT list_contains(g, string_split(c, ':')[1])) AS c, list_filter(document_ids, lambda x: NOT list_contains(g, x)) AS d FROM idx, lost)
          SELECT id, array_to_string(c, '|') AS chunk_ids, array_to_string(d, '|') AS document_ids FROM cut WHERE len(d) > 0""",
        "delete_rebuild": f"""WITH {_index(f"source NOT IN {DELETED}")} SELECT id, name, trim(name || '. Appears in: ' || array_to_string(ds, '; ')) AS description, array_to_string(chunk_ids, '|') AS chunk_ids FROM idx JOIN first_ ON first_.owner = owner_id AND first_.key = idx.key""",
        "replace_concepts": f"WITH {index} SELECT id, owner_id, CASE WHEN owner_id = 'fr' THEN upper(name) ELSE name END AS name FROM idx",
        "study_cards": f"WITH {_hybrid('true', fixed.CARDS)} SELECT query_id, 'What do your notes say about ' || coalesce('Topic label ' || label::VARCHAR, title) || '?' AS front, {lead('text')} AS back, coalesce('Topic label ' || label::VARCHAR, title) AS concept FROM ranked",
        "study_summary": f"WITH {_hybrid('true', fixed.KEY_POINTS)} SELECT query_id, {lead('text')} AS key_point FROM ranked",
        "study_context": f"""WITH {_hybrid('true', fixed.STUDY_K, questions=_ALL_QUESTIONS)}, c AS (SELECT query_id, string_agg('[' || rank::VARCHAR || '] ' || doc_title || ' — ' || title || ' — ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS c FROM ranked GROUP BY query_id)
          SELECT query_id, length(c)::BIGINT AS n_chars, sha1(c) AS context_sha1 FROM c""",
        "study_sources": f"WITH {_hybrid('true', fixed.STUDY_K)} SELECT query_id, rank, document_id || ':' || seq::VARCHAR AS chunk_id, doc_title AS document_title, {snippet('text', 200)} AS snippet FROM ranked",
        "semantic_fusion": f"WITH {_hybrid('true', fixed.MAX_K, fixed.SEMANTIC_WEIGHTS, questions=_ALL_QUESTIONS)} SELECT query_id, seq, rank, round(score, 6) AS score FROM ranked",
        "filter_candidates": _candidates(),
        "search_meta": _META,
        "hashed_embedding": _embedding(),
        "chunk_notes": f"WITH RECURSIVE {NOTES_SQL}, {STRUCTURED_SQL}, {chunks('structured')} SELECT doc_id, ordinal, length(text)::BIGINT AS n_chars, sha1(text) AS text_sha1, array_to_string(headings, '|') AS headings, label, confidence FROM chunked",
    }
