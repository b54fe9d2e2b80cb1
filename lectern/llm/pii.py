"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.spans import let, match_spans

#: Kinds that are always kept when their check holds, in output order.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds; they need a checksum or a context word.
ADDED_KINDS = ("iban", "phone_local", "secret", "access_key", "credential")
#: Those of them that words about secrets raise.
SECRET_KINDS = ("secret", "access_key", "credential")

#: Where an ASCII word starts and ends, whatever other letters stand around it.
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Length of an IBAN by its country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """By the country's length, so that what follows an IBAN is not taken for a part of it; spaces may stand anywhere between."""
    by_length = "|".join(rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())
    return f"{START}(?:{by_length}){END}"


#: Names that a credential is assigned to.
_ASSIGNED = "(?:password|passwd|pwd|secret|token|api_?key)"
#: The fixed patterns, in forms that match the same spans in linear time: a match
#: can only start where its run of characters starts or the last match ended, and
#: nothing that follows a possessive run could use what it has taken.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": f"{START}[0-9A-Fa-f]{{32,}}{END}",
    # keys that their issuers give a fixed start and length
    "access_key": f"{START}(?:(?:AKIA|ASIA)[A-Z0-9]{{16}}|gh[oprsu]_[A-Za-z0-9]{{36}}|[rs]k_live_[A-Za-z0-9]{{24,}}|xox[abeoprs]-[A-Za-z0-9-]{{9,}}[A-Za-z0-9]){END}",
    "credential": f"(?i){START}{_ASSIGNED}\\x20{{0,2}}[=:]\\x20{{0,2}}[\"']?[A-Za-z0-9_]{{8,}}{END}",
}
#: A cheap test that every text with a match of the kind passes.
PROBES = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "phone_local": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    "secret": "[0-9A-Fa-f]{32}",
    "access_key": "(?:AKIA|ASIA)[A-Z0-9]|gh[oprsu]_|k_live_|xox[abeoprs]-",
    "credential": rf"(?i){_ASSIGNED}\x20{{0,2}}[=:]",
}
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "phone_local": 0.4, "secret": 0.4, "access_key": 0.6, "credential": 0.4}
#: Words within WINDOW characters that raise or lower a span's score by STEP: of personal data, of secrets, and of what only looks like either.
PERSONAL_WORDS = "tel|phone|call|mobile|fax|contact|mail|email|card|visa|iban|account|bank|address|ip"
SECRET_WORDS = "token|key|api|apikey|secret|password|passwd|pwd|auth|bearer|credential|credentials"
OTHER_WORDS = "order|invoice|version|isbn|ref|serial|example|test|commit|checksum|md5|sha1|sha256"
WINDOW, STEP, THRESHOLD = 40, 0.2, 0.5


def word_of(listed: str) -> str:
    return f"(?i){START}(?:{listed}){END}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn: every second digit from the right counts double, less 9 above 9."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _mod97(value: Column) -> Column:
    """Whether an IBAN's remainder by 97 is 1, its first four characters moved to the end and letters read as 10 to 35."""
    s = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The checksum or range test of a kind."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"\A0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\z"))
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return _mod97(value)
    different = lambda x: F.size(F.array_distinct(F.filter(F.split(F.lower(x), ""), lambda c: c != "")))
    if kind == "secret":
        # drawn at random, 32 hex digits hold letters, digits and many different ones
        return value.rlike("[0-9]") & value.rlike("[A-Fa-f]") & (different(value) >= 8)
    if kind == "access_key":
        return different(value) >= 8
    if kind == "credential":
        # words are no credentials; keys of the other kinds are left to them
        given = F.regexp_extract(value, r"[A-Za-z0-9_]+\z", 0)
        return given.rlike("[0-9]") & given.rlike("[A-Za-z]") & ~given.rlike(PATTERNS["secret"]) & ~given.rlike(PATTERNS["access_key"])
    return F.lit(True)


def _scored(kind: str, text: Column) -> Column:
    def one(s: Column) -> Column:
        around = F.substring(text, F.greatest(s["start"] + 1 - WINDOW, F.lit(1)), s["end"] - s["start"] + 2 * WINDOW)
        raises = word_of(SECRET_WORDS if kind in SECRET_KINDS else PERSONAL_WORDS)
        score = F.lit(BASE_SCORE[kind]) + F.when(around.rlike(raises), STEP).otherwise(0.0) - F.when(around.rlike(word_of(OTHER_WORDS)), STEP).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.round(F.least(score, F.lit(1.0)), 3).alias("score"))

    found = F.transform(F.filter(match_spans(text, PATTERNS[kind]), lambda s: confirmed(kind, s["value"])), one)
    if kind in ADDED_KINDS:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    probe = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(PROBES[kind])
    return F.when(probe, found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>"))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the column ``out``: array<struct<kind,start,end,value,score>>, by kind, then start.

    Offsets are code points, ends exclusive. Base kinds (e-mail, IP, card, phone)
    stay whatever their score; the added kinds (IBAN by mod-97, local phone
    numbers and hexadecimal secrets by a context word, issuers' access keys, and
    credentials with the name that they are assigned to) need ``THRESHOLD``. Null or empty text gives an
    empty array. A column of the name ``out`` in ``docs`` is replaced, all others
    pass through; rows are neither dropped nor merged, and nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, let(text, lambda t: F.concat(*(_scored(k, t) for k in (*BASE_KINDS, *ADDED_KINDS)))))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
