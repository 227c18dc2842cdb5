"""Secret scans over a trigram inverted index.

Each rule's pattern gives a Boolean trigram query. The index holds, for each trigram that some rule
asks for, the documents that contain it (in lower case). Postings are intersected for each
alternative of a rule's query by counting; documents that meet one are the rule's candidates, and its
pattern runs on those only. Rules without a mandatory trigram scan all texts. Built-in functions only.

A document's key in the index is a hash of its id and text, so a hot id, source or copied text meets
no single task, and a collision only adds a candidate that the pattern then rejects. Candidates are
broadcast up to BROADCAST_ROWS (24 bytes each) and joined by a shuffle beyond.

Nulls, empty and long texts: a null text is an empty one and has no spans; long texts are searched
whole. Repeated rows give repeated results; an empty table gives none; other columns pass through
unless named as the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spans import clean, find
from .trigrams import ALWAYS, trigram_query

BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    base: bool
    group: int = 0  # the group whose length counts
    least: int = 0  # code points that it must have


RULES = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", True, 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", False),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", False),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False),
]
RESULT = "array<struct<start:int,rank:int,end:int,kind:string,text:string>>"


def _key(text: Column, ids: list[str]) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c in ids), text)


def build_index(docs: DataFrame, trigrams: list[str], text_col: str = "text", ids: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The inverted index over given trigrams: a row (trigram, doc_key) per posting."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_key(text, ids).alias("doc_key"), F.lower(text).alias("folded"))
    held = F.filter(F.array(*(F.lit(t) for t in trigrams)), lambda t: F.contains(F.col("folded"), t))
    return rows.select("doc_key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule], text_col: str = "text", ids: list[str] = ["doc_id"]) -> tuple[DataFrame, set[int]]:  # noqa: B006
    """(doc_key, mask): bit r of mask is set if the document meets rule r's query; and the rules that scan fully."""
    asked = [trigram_query(r.pattern) for r in rules]
    full = {i for i, q in enumerate(asked) if ALWAYS <= q}
    terms = [(t, i, a, len(alternative)) for i, q in enumerate(asked) if i not in full for a, alternative in enumerate(sorted(q, key=sorted)) for t in sorted(alternative)]
    wanted = docs.sparkSession.createDataFrame(terms, "trigram string, rule int, alternative int, needed long")
    index = build_index(docs, sorted({t[0] for t in terms}), text_col, ids)
    # The wanted side is a few rows a rule; each document's postings come from one row of the input.
    met = index.distinct().join(F.broadcast(wanted), "trigram").groupBy("doc_key", "rule", "alternative", "needed").count().filter("count = needed")
    return met.groupBy("doc_key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask")), full


def _verified(text: Column, rank: int, rule: Rule) -> Column:
    found = find(text, rule.pattern)
    if rule.least:
        part = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
        found = F.filter(found, lambda s: F.char_length(part(s["text"])) >= rule.least)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.name).alias("kind"), s["text"].alias("text")))


def find_secrets(docs: DataFrame, text_col: str = "text", ids: list[str] = ["doc_id"], out_col: str = "secret_spans", rules: list[Rule] = RULES) -> DataFrame:  # noqa: B006
    """Add out_col: spans of secrets by start, then rule."""
    met, full = candidates(docs, rules, text_col, ids)
    met = materialize(met, "secret-candidates").select(F.col("doc_key").alias("__key"), F.col("mask").alias("__mask"))
    if met.count() <= BROADCAST_ROWS:
        met = F.broadcast(met)
    key = _key(F.coalesce(F.col(text_col), F.lit("")), ids)
    rows = docs.join(met, key == F.col("__key"), "left")
    text = clean(F.col(text_col))
    none = F.array().cast(RESULT)
    found = [_verified(text, i, r).cast(RESULT) if i in full else F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0, _verified(text, i, r).cast(RESULT)).otherwise(none) for i, r in enumerate(rules)]
    return rows.withColumn(out_col, F.array_sort(F.concat(*found))).drop("__key", "__mask")


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """Replace each span of text_col by [kind]; overlapping spans become one, named by the first."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(F.col(text_col), a["at"] + 1, s["start"] - a["at"])
        fresh = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], kept, F.lit("["), s["kind"], F.lit("]"))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(F.col(spans_col), first, step, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.char_length(F.col(text_col)))))
    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, done).otherwise(F.col(text_col)))
