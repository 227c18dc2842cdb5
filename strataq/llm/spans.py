"""Positions of regular-expression matches, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sets matches off inside a text; a text's own mark is read as another control character, which no
#: pattern here matches, so positions stay.
MARK, OTHER = "\x01", "\x02"
SPAN = "struct<start:int,end:int,text:string>"


def clean(text: Column) -> Column:
    """Null as empty, without MARK; as many code points as before."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)


def find(text: Column, pattern: str, likely: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern in a clean text: an array of SPAN, in code points.

    likely: a cheaper test that is true wherever the pattern matches.
    """
    none = F.array().cast(f"array<{SPAN}>")
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))

    def step(a: Column, part: Column) -> Column:
        end = a["at"] + F.char_length(part)
        span = F.struct(a["at"].alias("start"), end.alias("end"), part.alias("text"))
        out = F.when(a["inside"], F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), out.alias("out"))

    found = F.aggregate(parts, first, step, lambda a: a["out"])
    test = text.rlike(pattern)
    return F.when(test if likely is None else likely & test, found).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
