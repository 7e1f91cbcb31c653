"""Personal data: regular expressions propose spans, checksum validators confirm
them, nearby context words adjust their score - DataFrame functions only.

Kinds ``email ip card phone`` are proposed by the base patterns and kept when
their check holds (parts up to 255, Luhn, digit counts).  The method adds
``iban`` (mod-97 must hold) and ``ssn`` (three groups of digits, no checksum, so
only context words lift it over ``MIN_SCORE``).

An IBAN has the length of its country, so a word behind it stays outside; codes of
countries without IBANs are none.

The patterns below match what the plain forms in the comments match, written so
that a scan is linear and needs no recursion on long runs: possessive
repetition where the next token cannot start inside the run, and a look-behind
where a match can only begin at the start of a run.

Positions are code points, end exclusive: a match begins after all gaps and
matches before it, so they come from the lengths of the pieces that ``split``
and ``regexp_extract_all`` return for the same pattern.

Defined results: null text is empty; no spans is an empty array; spans of
different kinds may overlap and are all returned; masking merges overlapping
spans under the first one's kind; rows are independent, so repeated rows and
null ids pass through; an empty table gives an empty table.  Other columns are
kept as they are (masking) or ignored (spans).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import let

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]

_LOCAL = "[A-Za-z0-9._%+-]"
#: Length of an IBAN -> countries: the registry, and codes in use outside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban(length: int, countries: str) -> str:
    """Country, check digits, groups of four and what is left, spaces between allowed."""
    fours, left = divmod(length - 4, 4)
    return rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}" + (
        rf"\x20?[A-Z0-9]{{{left}}}" if left else "")


#: kind -> pattern.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a match begins where a
    # run of local characters does, or right after the match before it.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # [0-9]([\x20-]?[0-9])+ ; runs under 16 digits would fail the check anyway.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(
        _iban(n, c) for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters a text must hold for the kind to be looked for at all.
_HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a span that passed its check, and words near it that raise the score.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": "e-?mail|contact|write|mail",
    "ip": "ip|address|server|host|login",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security|social-security",
}
CONTEXT_BONUS = 0.1
CONTEXT_CHARS = 40
#: Added kinds need this score; the base kinds stay whatever their score is.
MIN_SCORE = 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    def add(total: Column, pair: Column) -> Column:
        return total + pair

    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(
        c.cast("int") * (F.lit(1) + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(doubled, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Check of an IBAN: the country and check digits go last, letters count 10
    to 35, and the number leaves 1 modulo 97."""
    code = F.regexp_replace(iban, " ", "")

    def digit(rest: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c.between("0", "9"), (rest * 10 + v) % 97).otherwise((rest * 100 + v) % 97)

    return let(code, lambda s: F.char_length(s).between(15, 34) & (F.aggregate(
        F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), ""), F.lit(0), digit) == 1))


def _small(part: Column) -> Column:
    """A run of digits that is at most 255, leading zeros allowed."""
    return let(F.regexp_replace(part, "^0+(?=[0-9])", ""),
               lambda d: (F.char_length(d) <= 3) & (F.substring(d, 1, 3).cast("int") <= 255))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, "\\."), _small),
    "card": lambda m: let(_digits(m), lambda d: F.char_length(d).between(16, 19) & luhn(d)),
    "phone": lambda m: F.char_length(_digits(m)).between(8, 15),
    "iban": mod97,
    "ssn": lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"),
}


def _proposed(text: Column, kind: str) -> Column:
    """Matches of the kind's pattern with their positions."""
    pattern = F.lit(PATTERNS[kind])

    def placed(matches: Column) -> Column:
        def put(gaps: Column) -> Column:
            def add(s: Column, i: Column) -> Column:
                start = s["at"] + F.char_length(F.get(gaps, i))
                end = start + F.char_length(F.get(matches, i))
                return let(F.struct(start.alias("a"), end.alias("b")), lambda p: F.struct(
                    p["b"].alias("at"), F.concat(s["spans"], F.array(F.struct(
                        p["a"].alias("start"), p["b"].alias("end"), F.get(matches, i).alias("match")))).alias("spans")))
            none = F.array().cast("array<struct<start:int,end:int,match:string>>")
            return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1),
                               F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda s: s["spans"])
        return let(F.split(text, PATTERNS[kind], -1), put)

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    hint = F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else F.lit(True)
    found = let(F.regexp_extract_all(text, pattern, F.lit(0)),
                lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))
    return F.when(hint, found).otherwise(none)


def _scored(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind with their score."""
    def score(s: Column) -> Column:
        before = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.concat(F.substring(text, before + 1, s["start"] - before), F.lit(" "),
                        F.substring(text, s["end"] + 1, F.lit(CONTEXT_CHARS)))
        value = F.lit(SCORES[kind]) + F.when(near.rlike(f"(?i)\\b(?:{CONTEXT[kind]})"), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"),
                        s["end"].alias("end"), F.round(value, 3).alias("score"))

    spans = F.transform(F.filter(_proposed(text, kind), lambda s: CHECKS[kind](s["match"])), score)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)


def find_spans(text: Column) -> Column:
    """Spans of a text: array of (rank, kind, start, end, score), in the order of
    ``KINDS``, then of their start."""
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: F.concat(*[_scored(t, k) for k in KINDS]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[KIND]``; null stays null."""
    def cut(s: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(
            x["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(by_start, start, cut, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, counts and digests of the spans, and the spans."""
    spans = docs.select(F.col(id_col), find_spans(F.col(text_col)).alias("found"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        id_col, *[number(kind) for kind in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found")
