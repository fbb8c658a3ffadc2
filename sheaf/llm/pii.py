"""Personal data (operator 7): patterns propose, checksums confirm, context adjusts the score.

Built-in functions only; a row needs no other row, so nothing is shuffled.  The base kinds
are reported whatever their score.  The method adds account numbers (``iban``) whose mod-97
checksum holds, and ``ssn`` where a word nearby names such a number.

Patterns are written so that time stays in proportion to the text: a local part is tried only
where its run of characters begins (or a match has just ended), and repeats are possessive
where what follows cannot take their characters.

Defined cases: null or empty texts have no spans; repeated rows each have theirs; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.spans import described, find, joined, let
from sheaf.llm.common import text_or_empty

_LOCAL = "A-Za-z0-9._%+-"
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRIES = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: A known country's number has its length, whatever follows; another country's runs on, up to the next number of a known one.
_IBAN = "|".join(
    [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()]
    + [rf"(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:\x20(?!(?:{_COUNTRIES})[0-9]{{2}})[A-Z0-9]|[A-Z0-9]){{11,30}}"]
)
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # a whole chain of digits with single separators, 16 to 19 of them
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A character that every match holds; texts without it skip the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed pattern, before context.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": "host|server|address|login|network|adresse|direcci",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|mobile|contact|telefon|appel|llam|fax",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": "social|security|ssn|taxpayer",
}
NEAR = 40  # characters on either side that count as context
CONTEXT_WEIGHT = 0.2
ADDED_SCORE = 0.5  # spans of the added kinds need it


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """From the right, every second digit doubles (less 9 beyond 9); the sum must divide by 10."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, -i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return acc + F.when(i % 2 == 0, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(_digits(text), total) % 10 == 0


def mod97(text: Column) -> Column:
    """The first four characters go last, letters count 10 to 35; the number must leave 1."""

    def rest(s: Column) -> Column:
        chars = F.split(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4)), "")

        def add(acc: Column, c: Column) -> Column:
            return F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

        return F.aggregate(chars, F.lit(0), add)

    return let(F.replace(text, F.lit(" "), F.lit("")), rest) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return F.regexp_like(s, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return mod97(s)
    return F.lit(True)


def _scored(text: Column, spans: Column, kind: str) -> Column:
    def one(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(NEAR)).cast("int"))
        after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(NEAR))
        near = F.regexp_like(F.lower(F.concat_ws(" ", before, after)), F.lit(CONTEXT[kind]))
        score = F.lit(PRIOR[kind]) + F.when(near, CONTEXT_WEIGHT).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score.alias("score"))

    return F.transform(spans, one)


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each kind, its spans as (kind, start, end, text, score)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    text = F.col("text")

    def found(kind: str) -> Column:
        spans = F.filter(find(text, PATTERNS[kind]), lambda s: _valid(kind, s["text"]))
        spans = _scored(text, spans, kind)
        if kind not in BASE:
            spans = F.filter(spans, lambda s: s["score"] >= ADDED_SCORE)
        present = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        return F.when(present, spans).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>")).alias(kind)

    return rows.select("doc_id", *[found(k) for k in PATTERNS])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and all spans as one string."""
    base = joined([described(F.col(k), k) for k in BASE])
    scores = F.concat(*[F.transform(F.col(k), lambda s: F.round(s["score"], 2)) for k in PATTERNS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(base, 256).alias("base_sha256"),
        joined([described(F.col(k), k) for k in PATTERNS]).alias("spans"),
        scores.alias("scores"),
    )
