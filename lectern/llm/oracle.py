"""DuckDB SQL of the queries that SQL can express: op1, op3, op5, op7, op11 and op13. The others are tested against brute force."""

from __future__ import annotations

from lectern.llm import pii, quality, url_trust

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
  g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""


def op1() -> str:
    rules = sorted(url_trust.RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(h, p, v)}'" for h, p, v in rules) + " END"
    rest = "CASE WHEN {0} LIKE '%://%' THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    link = url_trust.LINK.replace("'", "''")
    d, steps = url_trust.DAMPING, []
    for i in range(url_trust.ITERATIONS):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
          SELECT n.kind, n.dst AS host, n.w * r.score * {d} AS score FROM normal n JOIN r{i} r ON r.kind = n.kind AND r.host = n.src
          UNION ALL SELECT kind, host, score * (1 - {d}) FROM r0) GROUP BY ALL)""")
    return f"""WITH u AS (SELECT page_id, html, {host.format("coalesce(url, '')")} AS host, regexp_extract({rest.format("coalesce(url, '')")}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
      judged AS (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS ruled FROM u),
      found AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS l FROM u),
      links AS (SELECT src, {host.format("(CASE WHEN starts_with(l, '//') THEN 'http:' || l ELSE l END)")} AS dst FROM found),
      edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
      merged AS (SELECT kind, src, dst, sum(w) AS w FROM (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges) GROUP BY ALL),
      normal AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS w FROM merged),
      seeds AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS m FROM judged WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL),
      r0 AS MATERIALIZED (SELECT kind, host, m / sum(m) OVER (PARTITION BY kind) AS score FROM seeds),
      {", ".join(steps)},
      by_host AS (SELECT host, coalesce(round(sum(score) FILTER (kind = 'trust'), 9), 0.0) AS trust, coalesce(round(sum(score) FILTER (kind = 'distrust'), 9), 0.0) AS distrust FROM r{url_trust.ITERATIONS} GROUP BY host)
      SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > {url_trust.BLOCK_SHARE} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict,
        coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust FROM judged j LEFT JOIN by_host b ON b.host = j.host"""


#: The base patterns as the contract has them.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _mod97(v: str) -> str:
    """Remainder of an IBAN, digit by digit: letters are two digits."""
    moved = f"substr(replace({v}, ' ', ''), 5) || substr(replace({v}, ' ', ''), 1, 4)"
    digits = f"array_to_string(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ord(c) - 55)::VARCHAR END), '')"
    return f"list_reduce(list_concat([0::BIGINT], list_transform(string_split({digits}, ''), lambda c: c::BIGINT)), lambda acc, c: (acc * 10 + c) % 97)"


def op3() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
    tests = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: try_cast(p AS HUGEINT) <= 255))",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"{_mod97('v')} = 1",
        "phone_local": "true",
        "secret": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Fa-f]') AND len(list_distinct(string_split(lower(v), ''))) >= 8",
    }
    # around whole ASCII words the boundary of this dialect is the look-around of the other
    plain = _PLAIN | {k: pii.PATTERNS[k].replace(pii.START, r"\b").replace(pii.END, r"\b").replace("'", "''") for k in ("iban", *pii.SECRET_KINDS)}
    given = "regexp_extract(v, '[A-Za-z0-9_]+$')"
    tests |= {
        "access_key": "len(list_distinct(string_split(lower(v), ''))) >= 8",
        "credential": f"regexp_matches({given}, '[0-9]') AND regexp_matches({given}, '[A-Za-z]') AND NOT regexp_matches({given}, '{plain['secret']}') AND NOT regexp_matches({given}, '{plain['access_key']}')",
    }
    word = lambda listed: f"regexp_matches(around, '(?i)\\b(?:{listed})\\b')"
    around = f"substr(t, greatest(s + 1 - {pii.WINDOW}, 1), length(v) + {2 * pii.WINDOW})"
    parts = []
    for n, kind in enumerate((*pii.BASE_KINDS, *pii.ADDED_KINDS)):
        if kind == "phone_local":
            # tried at every place; of two places with one end the first counts
            number = r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
            found = f"""SELECT doc_id, t, v, s FROM (SELECT *, lag(s + length(v)) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM (
              SELECT doc_id, t, i - 1 AS s, regexp_extract(substr(t, i, 15), '{number}') AS v FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM d WHERE regexp_matches(t, '[0-9]{{3}}[\x20.-][0-9]{{4}}'))
              WHERE i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[0-9+.-]')) WHERE v <> '' AND NOT regexp_matches(substr(t, s + length(v) + 1, 1), '[0-9]')) WHERE before IS NULL OR before <= s"""
        else:
            p = plain[kind]
            found = f"""SELECT doc_id, t, v[i] AS v, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[:i - 1], lambda x: length(x))), 0))::BIGINT AS s
              FROM (SELECT doc_id, t, v, g, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS v, regexp_split_to_array(t, '{p}') AS g FROM d))"""
        words = pii.SECRET_WORDS if kind in pii.SECRET_KINDS else pii.PERSONAL_WORDS
        score = f"round(least({pii.BASE_SCORE[kind]}::DOUBLE + CASE WHEN {word(words)} THEN {pii.STEP}::DOUBLE ELSE 0.0 END - CASE WHEN {word(pii.OTHER_WORDS)} THEN {pii.STEP}::DOUBLE ELSE 0.0 END, 1.0), 3)"
        least = f" WHERE score >= {pii.THRESHOLD}" if kind in pii.ADDED_KINDS else ""
        parts.append(f"SELECT * FROM (SELECT doc_id, {n} AS k, '{kind}' AS kind, v, s, {score} AS score FROM (SELECT *, {around} AS around FROM ({found}) WHERE {tests[kind]})){least}")
    joined = lambda which: f"coalesce(string_agg(kind || ':' || s::VARCHAR || ':' || (s + length(v))::VARCHAR, ',' ORDER BY k, s){which}, '')"
    base = f" FILTER (k < {len(pii.BASE_KINDS)})"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE_KINDS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
      a AS (SELECT doc_id, {counts}, {joined(base)} AS base, {joined('')} AS spans, count(*) FILTER (k >= {len(pii.BASE_KINDS)}) AS n_added, count(*) AS n_spans, max(score) AS score FROM f GROUP BY doc_id)
      SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
        coalesce(n_added, 0) AS n_added, coalesce(n_spans, 0) AS n_spans, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN a USING (doc_id)"""


def op7() -> str:
    word = r"[^\x20\x09-\x0D]+"
    chars, left = [], "t"
    for c in quality.CHAR_CLASSES:
        cut = f"regexp_replace({left}, '{c.replace(chr(39), chr(39) * 2)}', '', 'g')"
        chars.append(f"length({left}) - length({cut})")
        left = cut
    chars.append(f"length({left})")
    known = ", ".join(f"'{k}'" for k in quality.COMMON_WORDS)
    common = "CASE lang " + " ".join("WHEN '" + k + "' THEN [" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in quality.COMMON_WORDS.items()) + " END"
    shares = lambda c: f"list_transform({c}, lambda x: CASE WHEN list_sum({c}) > 0 THEN x / list_sum({c})::DOUBLE ELSE 0.0 END)"
    mean = lambda c, n: "[" + ", ".join(f"avg({c}[{i}])" for i in range(1, n + 1)) + "]"
    part = "CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(z[{0}] / ((z[1] + z[2]) / 2)) ELSE 0.0 END"
    dist = lambda p, r: f"round(sqrt(greatest(list_sum(list_transform(list_zip({p}, {r}), lambda z: ({part.format(1)} + {part.format(2)}) / 2)), 0.0)), 6)"
    n = len(quality.COMMON_WORDS["en"]) + 1
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE '' END AS lang FROM documents),
      w AS (SELECT *, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines, {common} AS cw FROM d),
      c AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
          (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, [{", ".join(chars)}] AS cc, list_transform(w, lambda x: lower(x)) AS lw, cw, w FROM w),
      e AS (SELECT *, CASE WHEN cw IS NULL THEN NULL ELSE list_concat(list_transform(cw, lambda x: len(list_filter(lw, lambda y: y = x))), [len(list_filter(lw, lambda y: NOT list_contains(cw, y)))]) END AS wc FROM c),
      tri AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM c)),
      rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM tri), range(0, 3) r(o) WHERE k > 1 GROUP BY doc_id),
      f AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, {shares("cc")} AS p, {shares("wc")} AS q FROM e LEFT JOIN rep USING (doc_id)),
      good AS (SELECT * FROM f WHERE n_words >= {quality.MIN_WORDS_CHARS} AND doc_id IN (SELECT doc_id FROM labels WHERE quality > 0)),
      ref AS (SELECT lang, {mean("p", len(quality.CHAR_CLASSES) + 1)} AS rp, {mean("q", n)} AS rq FROM good WHERE lang <> '' GROUP BY lang),
      every AS (SELECT {mean("p", len(quality.CHAR_CLASSES) + 1)} AS ra FROM good),
      h AS (SELECT f.*, coalesce(rp, ra) AS rp, rq FROM f LEFT JOIN ref USING (lang), every),
      j AS (SELECT h.*, CASE WHEN n_words >= {quality.MIN_WORDS_CHARS} AND rp[1] IS NOT NULL THEN {dist("p", "rp")} END AS char_distance, CASE WHEN n_words >= {quality.MIN_WORDS_COMMON} AND q IS NOT NULL AND rq IS NOT NULL THEN {dist("q", "rq")} END AS word_distance FROM h)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(char_distance, 0) <= {quality.MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {quality.MAX_WORD_DISTANCE} AS kept FROM j"""


#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda acc, b:
  list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN (x & 1) = 1 THEN 3988292384 ELSE 0 END)::BIGINT)), 4294967295::BIGINT)"""

#: Edit by edit: for each role kept last, the cheapest edits so far, those whose initials are least.
OP11 = f"""WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  summed AS (SELECT *, {_CRC} % 20 AS d FROM base),
  hit AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM summed, range(2) r(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
  numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hit),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, substr(role, 1, 1) AS ini FROM numbered),
  judged AS MATERIALIZED (SELECT conv_id, turn, role, text, i, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
    CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
  inserts AS (SELECT * FROM (VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
    ('', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'u', 3, 'I', chr(10) || 'user:'), ('u', 'a', 3, 'I', chr(10) || 'assistant:'), ('a', 'u', 3, 'I', chr(10) || 'user:')) t(was, state, price, edits, added)),
  ways AS (SELECT * FROM (VALUES ('', 's', 'system'), ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) t(was, state, named)),
  dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {{'c': 0, 'a': '', 'b': ''}} AS best FROM judged
    UNION ALL SELECT conv_id, i, state, min(best) AS best FROM (
      SELECT j.conv_id, j.i, d.state, {{'c': d.best.c + 4, 'a': d.best.a || 'D', 'b': d.best.b}} AS best FROM dp d JOIN judged j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.i = d.i + 1
      UNION ALL SELECT j.conv_id, j.i, w.state, {{'c': d.best.c + n.price + CASE WHEN w.state = j.ini THEN 0 ELSE 3 END + CASE j.fault WHEN 'truncated' THEN 3 ELSE 0 END,
          'a': d.best.a || n.edits || CASE WHEN w.state = j.ini THEN 'K' ELSE 'R' END, 'b': d.best.b || n.added || chr(10) || CASE WHEN w.state = j.ini THEN j.role ELSE w.named END || ':' || j.text}} AS best
        FROM dp d JOIN judged j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.i = d.i + 1 JOIN inserts n ON n.was = d.state JOIN ways w ON w.was = n.state
        WHERE j.fault NOT IN ('blank', 'duplicate') AND (w.state = j.ini OR w.state <> 's')) GROUP BY conv_id, i, state),
  size AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
  ended AS (SELECT d.conv_id, min({{'c': best.c + CASE state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, 'a': best.a || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
      'b': best.b || CASE state WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END}}) AS best
    FROM dp d JOIN size s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.n = d.i GROUP BY d.conv_id)
  SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.b, 2), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN size s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

OP13 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
  e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
  links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reached AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reached r JOIN ways l ON l.a = r.b)
  SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN reached r ON r.a = s.doc_id GROUP BY s.doc_id, s.s"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_trust": op1(), "op3_pii": op3(), "op5_exact_dedup": OP5, "op7_quality_rules": op7(), "op11_turn_repair": OP11, "op13_set_join": OP13}
