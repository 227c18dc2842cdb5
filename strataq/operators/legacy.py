"""Import of an older archive: its JSON columns as typed fields, and one plan for a dry run and for the real one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, normalize_tr, parse_time
from .numbering import number_rows

#: JSON keys and the fields they become, kinds of images that are taken over, fields that an
#: analysis has at least, mark of its origin, and problems that a report lists.
TEXTS = {"dwgDescription": "ai_aciklama"}
LISTS = {"dwgElements": "ai_elemanlar", "dwgSpaces": "ai_mekanlar", "dwgDomainTerms": "ai_ozel_terimler"}
DRAWING, KEYWORDS = ("dwgDrawingType", "ai_cizim_turu"), ("dwgKeywords", "ai_anahtar_kelimeler")
IMAGE_KINDS, LEAST_FIELDS, ORIGIN, REPORTED = ["Fotoğraf", "Render"], 2, "h2-import", 50


def _string(value: Column) -> Column:
    """A variant's text, trimmed; null if it is anything but a text with something in it."""
    text = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when((F.schema_of_variant(value) == "STRING") & (text != ""), text)


def _member(root: Column, path: str) -> Column:
    return _string(F.try_variant_get(root, path, "variant"))


def _strings(root: Column, path: str, of: str = "$") -> Column:
    """The texts of a JSON array (of one member of its objects); none if it is no array."""
    items = F.coalesce(F.try_variant_get(root, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(items, lambda x: _string(x if of == "$" else F.try_variant_get(x, of, "variant"))), lambda t: t.isNotNull())


def map_fields(df: DataFrame, metadata: str, tags: str, analysed_at: str, drawing_types: list[str]) -> DataFrame:
    """Adds ai: struct<fields array<struct<key, value>>, image_kind, type_dropped, too_thin, bad_json>, null if
    both columns say nothing.

    A drawing's kind is clamped to the longest of drawing_types that its plain letters hold, and dropped if none
    fits. Fewer than LEAST_FIELDS fields are discarded; an image kind stays even so. bad_json tells text that is
    no JSON, from which nothing is taken.
    """
    texts = {c: F.col(f"`{c}`") for c in (metadata, tags)}
    root, labels = (F.try_parse_json(c) for c in texts.values())
    bad = F.lit(False)
    for parsed, raw in zip((root, labels), texts.values()):
        bad = bad | (parsed.isNull() & raw.isNotNull())
    raw_kind = _member(root, f"$.{DRAWING[0]}")
    order = sorted(range(len(drawing_types)), key=lambda i: (-len(drawing_types[i].encode()), i))
    kind = F.lit(None).cast("string")
    for i in reversed(order):
        kind = F.when(F.contains(normalize_tr(raw_kind), normalize_tr(F.lit(drawing_types[i]))), F.lit(drawing_types[i])).otherwise(kind)
    both = F.concat(_strings(root, f"$.{KEYWORDS[0]}"), _strings(labels, "$", "$.label"))
    folded = F.transform(both, normalize_tr)
    words = F.transform(F.filter(F.arrays_zip(both.alias("w"), folded.alias("f"), F.sequence(F.lit(1), F.greatest(F.size(both), F.lit(1))).alias("i")), lambda x: F.array_position(folded, x["f"]) == x["i"]), lambda x: x["w"])
    image = F.try_variant_get(root, "$.aiClassification.type", "string")
    image = F.when(image.isin(IMAGE_KINDS), image)
    found = [(DRAWING[1], kind), *((name, _member(root, f"$.{k}")) for k, name in TEXTS.items())]
    found += [(name, F.nullif(F.array_join(_strings(root, f"$.{k}"), ", "), F.lit(""))) for k, name in LISTS.items()]
    found.append((KEYWORDS[1], F.nullif(F.array_join(words, ", "), F.lit(""))))
    pair = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    content = F.filter(F.array(*(pair(n, v) for n, v in found)), lambda p: p["value"].isNotNull())
    out = df.withColumns({"__content": content, "__kind": raw_kind, "__image": image, "__bad": bad, "__dropped": raw_kind.isNotNull() & kind.isNull()})
    n = F.size("__content")
    at = parse_time(F.col(f"`{analysed_at}`"))
    origin = F.filter(F.array(pair("ai_model", F.lit(ORIGIN)), pair("ai_analyzed_at", (at * 1000).cast("string"))), lambda p: p["value"].isNotNull())
    fields = F.when(n >= LEAST_FIELDS, F.concat("__content", origin)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    ai = F.struct(fields.alias("fields"), F.col("__image").alias("image_kind"), F.col("__dropped").alias("type_dropped"), ((n > 0) & (n < LEAST_FIELDS)).alias("too_thin"), F.col("__bad").alias("bad_json"))
    says = (n > 0) | F.col("__kind").isNotNull() | F.col("__image").isNotNull() | F.col("__bad")
    return out.withColumn("ai", F.when(says, ai)).drop("__content", "__kind", "__image", "__bad", "__dropped")


def plan_import(catalog: DataFrame, legacy: DataFrame) -> DataFrame:
    """The legacy rows (legacy_id, path, deleted, ...) with action and id: what an import does with each.

    skip: deleted there, without a path, or a path that an earlier row (the smallest legacy_id) has; match: the
    path is catalogued, under its id; add: it is new, and gets the ids after the catalogue's greatest.
    """
    key = ascii_lower(F.col("path"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("legacy_id"))  # rows of one path are few
    known = catalog.groupBy(ascii_lower(F.col("path")).alias("__key")).agg(F.min("id").alias("__id"))
    usable = ~F.coalesce(F.col("deleted"), F.lit(False)) & (F.trim(F.coalesce("path", F.lit(""))) != "")
    rows = legacy.withColumns({"__key": key, "__usable": usable})
    live = rows.filter("__usable").withColumn("__nth", nth).join(known, "__key", "left")
    reason = F.when(F.col("__nth") > 1, "repeated path")
    live = live.withColumns({"action": F.when(reason.isNotNull(), "skip").when(F.col("__id").isNotNull(), "match").otherwise("add"), "reason": reason, "id": F.when(reason.isNull(), F.col("__id"))})
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = number_rows(live.filter("action = 'add'").drop("id"), ["legacy_id"], "id", top + 1)
    why = F.when(F.coalesce("deleted", F.lit(False)), "deleted").otherwise("no path")
    others = rows.filter("not __usable").withColumns({"action": F.lit("skip"), "reason": why, "id": F.lit(None).cast("long")})
    every = live.filter("action <> 'add'").unionByName(added).unionByName(others, allowMissingColumns=True)
    return every.drop("__key", "__usable", "__nth", "__id")


def import_report(plan: DataFrame) -> DataFrame:
    """One row: what the plan does, whether it is carried out or not, with the first REPORTED problems."""
    said = F.col("ai") if "ai" in plan.columns else F.lit(None).cast("struct<fields:array<struct<key:string,value:string>>,image_kind:string,type_dropped:boolean,too_thin:boolean,bad_json:boolean>")
    problem = F.when(F.col("reason").isin("no path", "repeated path"), F.col("reason")).when(said["bad_json"], "bad json").when(said["type_dropped"], "unknown drawing type")
    rows = plan.withColumns({"__problem": problem, "__said": said})
    listed = rows.filter("__problem is not null").select("legacy_id", "path", F.col("__problem").alias("problem")).orderBy("legacy_id").limit(REPORTED)
    problems = listed.agg(F.array_sort(F.collect_list(F.struct("legacy_id", "path", "problem"))).alias("problems"))  # REPORTED rows
    is_ = lambda c: F.count_if(c)
    counts = rows.agg(
        F.count(F.lit(1)).alias("seen"), is_(F.col("action") == "add").alias("added"), is_(F.col("action") == "match").alias("matched"), is_(F.col("action") == "skip").alias("skipped"),
        is_((F.col("action") != "skip") & (F.size(F.col("__said.fields")) > 0)).alias("analysed"), is_(F.col("__said.too_thin")).alias("too_thin"), is_(F.col("__said.type_dropped")).alias("types_dropped"), is_(F.col("__problem").isNotNull()).alias("problems_seen"),
    )
    return counts.crossJoin(problems)  # one row each


def apply_import(catalog: DataFrame, metadata: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, metadata) with what the plan adds; catalogued rows and the values they have stay as they are."""
    fresh = plan.filter("action = 'add'").select(*(F.col(c) if c in plan.columns else F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in catalog.columns))
    pairs = plan.filter("action <> 'skip' and ai is not null")
    image = F.when(F.col("ai.image_kind").isNotNull(), F.array(F.struct(F.lit("ai_gorsel_turu").alias("key"), F.col("ai.image_kind").alias("value"))))
    found = pairs.select(F.col("id").alias("asset_id"), F.explode(F.concat("ai.fields", F.coalesce(image, F.array().cast("array<struct<key:string,value:string>>")))).alias("p"))
    found = found.select("asset_id", "p.key", F.col("p.value").alias("value_text")).join(metadata.select("asset_id", "key"), ["asset_id", "key"], "left_anti")
    return catalog.unionByName(fresh), metadata.unionByName(found.select("asset_id", "key", "value_text"), allowMissingColumns=True)
