"""String functions as columns: words, tokens, snippets, HTML, concept names, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.spans import let

#: White space as browsers define it, as the inside of a character class.
SPACE = fixed.SPACES


def words_in(column: Column, listed: list[str]) -> Column:
    return column.isin(*listed)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(s: Column) -> Column:
    return F.regexp_replace(s, rf"[{SPACE}]+", " ")


def raw_words(text: Column) -> Column:
    """Lower-cased words, compounds whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.RAW_WORD), F.lit(0))


def surface_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.SURFACE_WORD), F.lit(0))


def tokenise(text: Column) -> Column:
    """Retrieval terms in order, with repeats: a compound gives its joined form, then its parts."""
    content = lambda w: (F.length(w) > 2) & ~words_in(w, fixed.STOPWORDS)

    def terms(w: Column) -> Column:
        joined = F.regexp_replace(w, "['’-]", "")
        parts = F.filter(F.split(w, "['’-]"), content)
        return F.when(w.rlike("['’-]"), F.concat(F.filter(F.array(joined), lambda j: F.length(j) > 2), parts)).otherwise(F.filter(F.array(w), content))

    return F.flatten(F.transform(raw_words(text), terms))


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def snippet(text: Column, limit: int = 240) -> Column:
    clean = trim(collapse(text))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 1), F.lit("…")))


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.SENTENCE), F.lit(0))


def lead_sentence(text: Column) -> Column:
    """The first sentence of 40 to 240 characters (the end of a longer one), else a snippet."""
    found = F.regexp_extract(collapse(text), fixed.LEAD_SENTENCE, 0)
    return trim(F.when(found == "", snippet(text, 200)).otherwise(found))


def normalise_newlines(text: Column) -> Column:
    return trim(F.regexp_replace(text, "\r\n", "\n"))


def strip_html(html: Column) -> Column:
    """Plain text with heading marks, as Markdown has them."""
    s = html
    for tag in ("script", "style"):
        s = F.regexp_replace(s, rf"(?is)<{tag}.*?</{tag}>", "")
    s = F.regexp_replace(s, r"(?i)</(?:p|div|li|tr|h[1-6])>", "\n")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n")
    for level in range(1, 7):
        s = F.regexp_replace(s, rf"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"')):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def normalise_concept(name: Column) -> Column:
    """The key under which spellings of a concept merge: case, punctuation and a final s don't count."""
    s = F.regexp_replace(F.lower(name), r"['’]s(?![a-z0-9_])", "")
    s = trim(collapse(F.regexp_replace(s, "[^a-z0-9 ]", " ")))
    return F.regexp_replace(s, r"([A-Za-z0-9_])s\z", "$1")


def is_concept_word(word: Column) -> Column:
    return ~words_in(word, fixed.STOPWORDS) & ~words_in(word, fixed.CONCEPT_STOPWORDS) & ~(word.endswith("ly") & (F.length(word) > 5))


def title_case(name: Column) -> Column:
    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        capital = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low)))
        return F.when(w.rlike(r"\A.[\s\S]*[A-Z]"), w).when((i > 0) & words_in(low, fixed.STOPWORDS), low).otherwise(capital)

    return F.array_join(F.transform(F.split(name, rf"[{SPACE}]+"), word), " ")


def heading_concept(heading: Column) -> Column:
    """What a section heading names, without a leading unit label; null if that is too short or too long."""
    rest = trim(F.regexp_replace(heading, rf"(?i)\A(?:{fixed.UNIT_NAMES})\s*\d+\s*[-–—:.]?\s*", ""))
    return F.when((F.length(rest) > 3) & (F.size(F.split(rest, rf"[{SPACE}]+")) <= 7), title_case(rest))


def markdown_heading(line: Column) -> Column:
    """struct<level,text> of a Markdown heading line, null for other lines."""
    pattern = rf"\A(#{{1,6}})[{SPACE}]+(.*[^{SPACE}])[{SPACE}]*\z"
    return F.when(line.rlike(pattern), F.struct(F.length(F.regexp_extract(line, pattern, 1)).alias("level"), F.regexp_extract(line, pattern, 2).alias("text")))


def is_bare_heading(line: Column) -> Column:
    """Whether a line that starts a block looks like a heading: short, opening with a capital or digit, without final punctuation."""
    t = trim(line)
    return F.length(t).between(1, 60) & (F.size(F.split(t, rf"[{SPACE}]+")) <= 9) & t.rlike(r"\A[A-Z0-9]") & ~t.rlike(r"[.,;:!?]\z")


def bare_heading_level(line: Column) -> Column:
    """2 for a unit heading, 3 for others."""
    return F.when(trim(line).rlike(rf"(?i)\A(?:{fixed.UNIT_NAMES}|w\d)(?![A-Za-z0-9_])"), 2).otherwise(3)


def tail_overlap(text: Column) -> Column:
    """The last characters of a chunk that the next one repeats, from the first sentence start in them on."""
    tail = F.substring(text, -fixed.CHUNK_OVERLAP, fixed.CHUNK_OVERLAP)
    at = F.regexp_instr(tail, F.lit(rf"[.!?][{SPACE}]"))
    return F.when(F.length(text) <= fixed.CHUNK_OVERLAP, text).when(at == 0, tail).otherwise(F.substring(tail, at + 2, F.length(tail)))


def short_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of parts joined by colons."""
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 16)


def owner_id(email: Column) -> Column:
    return F.substring(F.sha1(F.lower(trim(email))), 1, 16)


def document_id(owner: Column, kind: Column, external_id: Column) -> Column:
    return short_id(owner, kind, external_id)


def chunk_id(document: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", document, ordinal.cast("string"))


def display_name(email: Column) -> Column:
    local = F.split(trim(email), "@")[0]
    words = F.filter(F.split(local, "[._-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def is_email(email: Column) -> Column:
    return trim(email).rlike(r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z")


def build_user(email: Column) -> Column:
    return F.struct(owner_id(email).alias("id"), display_name(email).alias("name"), trim(email).alias("email"))


#: What a browser's encoder leaves as it is and a form's doesn't, and the other way round.
_URL = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def session_cookie(user: Column) -> Column:
    """A signed-in user (id, name, email) as a cookie's value."""
    out = F.url_encode(F.to_json(F.struct(user["id"].alias("id"), user["email"].alias("email"), user["name"].alias("name"))))
    for a, b in _URL:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def session_user(cookie: Column) -> Column:
    """struct<id,name,email> from a cookie's value; null if it is malformed or names no id or e-mail. A missing name is made from the e-mail."""

    def read(u: Column) -> Column:
        full = (F.coalesce(u["id"], F.lit("")) != "") & (F.coalesce(u["email"], F.lit("")) != "")
        return F.when(full, F.struct(u["id"].alias("id"), F.coalesce(u["name"], display_name(u["email"])).alias("name"), u["email"].alias("email")))

    return let(F.from_json(F.call_function("try_url_decode", cookie), "id string, email string, name string"), read)


def file_title(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def is_supported(name: Column) -> Column:
    return F.lower(name).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in fixed.EXTENSIONS) + r")\z")


def lexical_text(headings: Column, concepts: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.array_join(headings, " "), F.array_join(concepts, " "), text)


def embedding_text(headings: Column, concepts: Column, text: Column) -> Column:
    parts = F.array(F.array_join(headings, " › "), F.array_join(concepts, ", "), text)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def concept_description(name: Column, contexts: Column) -> Column:
    return trim(F.concat(name, F.lit(". Appears in: "), F.array_join(F.array_distinct(contexts), "; ")))


def card_concept(concepts: Column, headings: Column, title: Column) -> Column:
    return F.coalesce(F.get(concepts, F.lit(0)), F.try_element_at(headings, F.lit(-1)), title)


def card_front(concept: Column) -> Column:
    return F.concat(F.lit("What do your notes say about "), concept, F.lit("?"))


def outline(ordinal: Column, headings: Column, text: Column) -> Column:
    """One section as a model prompt shows it."""
    return F.concat(F.lit("["), ordinal.cast("string"), F.lit("] "), F.array_join(headings, " › "), F.lit("\n"), snippet(text, 700))


def clean_model_concepts(names: Column) -> Column:
    return F.slice(F.filter(F.transform(names, trim), lambda c: c != ""), 1, 4)


def page_text(pages: Column) -> Column:
    """Pages of extracted text: blanks collapsed, at most one empty line, empty pages dropped, pages a blank line apart."""
    clean = F.transform(pages, lambda p: trim(F.regexp_replace(F.regexp_replace(p, r"[ \t]+", " "), r"\n{3,}", "\n\n")))
    return F.array_join(F.filter(clean, lambda p: p != ""), "\n\n")


def toggle(values: Column, value: Column) -> Column:
    return let(F.array_contains(values, value), lambda has: F.when(has, F.array_remove(values, value)).otherwise(F.array_append(values, value)))
