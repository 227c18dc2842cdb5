"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Built-in functions only. Each kind has a pattern; a match that fails its check (parts of an address,
Luhn, mod 97, number of digits) is dropped without another try. A span's score starts from its kind's
weight, rises with a passed checksum and with a word of the kind close by, and falls where words such
as "example" stand by. Base kinds are kept whatever their score; further kinds need MIN_SCORE.

Nulls, empty and long texts: a null text is an empty one and has no spans; long texts are searched
whole. Repeated rows give repeated results; an empty table gives none; other columns pass through
unless named as one of the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import clean, find

MIN_SCORE = 0.5
#: Code points before and after a span in which words adjust its score.
BEFORE, AFTER = 40, 20
DOUBT = r"(?i)\b(?:example|sample|dummy|test|fake|placeholder|version|invoice|order)\b"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, F.lit("[^0-9]"), F.lit(""))


def _mod97(match: Column) -> Column:
    """The remainder of an account number with its first four signs moved to the end, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0), step)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: bool
    weight: float
    context: str
    check: object = None  # Column -> boolean Column
    likely: object = None  # Column -> boolean Column: a cheap necessary condition


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: A run starts where none is open, or where the last match ended inside it.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.9, r"(?i)\b(?:e-?mail|mail|contact|write)\b", likely=lambda t: F.contains(t, F.lit("@"))),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, r"(?i)\b(?:ip|host|address|server|login)\b", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    Kind("card", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", True, 0.4, r"(?i)\b(?:card|credit|visa|mastercard|payment)\b", lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)), lambda t: t.rlike(r"(?:[0-9][\x20-]?){11}[0-9]")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.7, r"(?i)\b(?:tel|phone|call|mobile|fax)\b", lambda m: F.length(_digits(m)).between(9, 15), lambda t: F.contains(t, F.lit("+"))),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", False, 0.5, r"(?i)\b(?:iban|account|bank)\b", lambda m: _mod97(m) == 1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.3, r"(?i)\b(?:ssn|social|security|tax)\b", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$")),
]
CHECKSUM = {"card", "iban"}
RESULT = "array<struct<start:int,rank:int,end:int,kind:string,text:string,score:double>>"


def _scored(text: Column, rank: int, kind: Kind) -> Column:
    found = find(text, kind.pattern, kind.likely(text) if kind.likely else None)
    if kind.check:
        found = F.filter(found, lambda s: kind.check(s["text"]))

    def scored(s: Column) -> Column:
        near = F.concat(F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))), F.lit("\n"), F.substring(text, s["end"] + 1, F.lit(AFTER)))
        score = F.lit(kind.weight + (0.3 if kind.name in CHECKSUM else 0.0)) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0) - F.when(near.rlike(DOUBT), 0.2).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), s["text"].alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 3))).alias("score"))

    found = F.transform(found, scored)
    return found if kind.base else F.filter(found, lambda s: s["score"] >= MIN_SCORE)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """Add out_col: spans by start, then kind, each with its text and score."""
    text = clean(F.col(text_col))
    spans = F.array_sort(F.concat(*(_scored(text, i, k) for i, k in enumerate(KINDS))))
    return docs.withColumn(out_col, spans.cast(RESULT))
