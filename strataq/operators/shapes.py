"""Outlines of drawings: features as columns, search by likeness or features, and structural duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..plans.shared import materialize
from .graph import connected_components

FEATURES = ["vertices", "compactness", "regularity", "aspect", "rectangularity", "solidity"]
TOP, TOP_MAX = 50, 200
#: Parts of layer names that tell a category, by priority.
LAYERS = [("HAVUZ", "HAVUZ|POOL|BASIN"), ("DUVAR", "DUVAR|WALL|MURO"), ("KAPI", "KAPI|DOOR|PORTA"), ("PENCERE", "PENCERE|WINDOW|CAM"), ("KOLON", "KOLON|COLUMN"), ("KIRIS", "KIRIS|KIRIŞ|BEAM"), ("MERDIVEN", "MERDIVEN|MERDİVEN|STAIR"), ("DOSEME", "DOSEME|DÖŞEME|SLAB|FLOOR"), ("CATI", "CATI|ÇATI|ROOF")]


def outline_features(df: DataFrame, points: str, closed: str) -> DataFrame:
    """Adds features of outlines given as arrays of (x, y): open ones have length and aspect alone."""
    p = F.col(points)
    w, h = geometry.box(p)
    area = F.when(F.col(closed), geometry.area(p)).otherwise(0.0)
    length = F.when(F.col(closed), geometry.perimeter(p)).otherwise(geometry.perimeter(p, False))
    out = df.withColumn("vertices", F.size(p)).withColumn("area", area).withColumn("perimeter", length)
    out = out.withColumn("aspect", F.when(h > 1e-9, w / h).otherwise(0.0))
    out = out.withColumn("regularity", F.when(F.col(closed), geometry.regularity(p)).otherwise(0.0))
    out = out.withColumn("solidity", F.when(F.col(closed), geometry.solidity(p)).otherwise(0.0))
    out = out.withColumn("compactness", geometry.compactness(F.col("area"), F.col("perimeter")))
    return out.withColumn("rectangularity", F.when(F.col(closed), geometry.rectangularity(p)).otherwise(0.0))


def searchable(df: DataFrame) -> DataFrame:
    """Closed outlines of three corners or more, circles, open ones of three points or more, and arcs."""
    kind = F.col("entity_type")
    return df.filter((kind != "LINE") & (kind.isin("CIRCLE", "ARC") | (F.col("vertices") >= 3)))


def layer_category(layer: Column) -> Column:
    out = F.lit("DIGER")
    for name, pattern in reversed(LAYERS):
        out = F.when(F.upper(layer).rlike(pattern), name).otherwise(out)
    return F.when(layer.isNull(), F.lit(None)).otherwise(out)


@dataclass
class ShapeCriteria:
    vertices: int | None = None
    tolerance: int = 0
    min_regularity: float | None = None
    min_compactness: float | None = None
    min_rectangularity: float | None = None
    aspect: tuple[float, float] | None = None
    category: str | None = None
    closed_only: bool = False


def filter_shapes(df: DataFrame, c: ShapeCriteria) -> DataFrame:
    if c.vertices is not None:
        df = df.filter(F.col("vertices").between(c.vertices - c.tolerance, c.vertices + c.tolerance))
    for name in ("regularity", "compactness", "rectangularity"):
        if (least := getattr(c, f"min_{name}")) is not None:
            df = df.filter(F.col(name) >= least)
    if c.aspect:
        df = df.filter(F.col("aspect").between(*c.aspect))
    if c.category:
        df = df.filter(F.col("category") == c.category)
    return df.filter("closed") if c.closed_only else df


def _columns(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in [*FEATURES, "closed"]}


def similar_shapes(df: DataFrame, goal: dict, asset: str = "asset_id", k: int = TOP) -> DataFrame:
    """Assets by their most similar shape to one given by its features."""
    other = {n: F.lit(v) for n, v in goal.items()}
    scores = df.select(asset, geometry.shape_similarity(_columns(), other).alias("score"))
    return scores.groupBy(asset).agg(F.max("score").alias("score")).orderBy(F.desc("score"), asset).limit(max(1, min(k, TOP_MAX)))


def feature_search(df: DataFrame, asset: str = "asset_id", k: int = TOP) -> DataFrame:
    """Assets by how regular (closed) or drawn out (open) their best shape is."""
    closed = 0.30 * F.col("regularity") + 0.25 * F.col("compactness") + 0.20 * F.col("rectangularity") + 0.15 * F.col("solidity") + 0.10
    opened = 0.40 * F.col("regularity") + 0.30 / (1 + F.abs(F.col("aspect") - 1)) + 0.20 * F.least(F.col("vertices") / 20, F.lit(1.0)) + 0.10
    scores = df.select(asset, F.when(F.col("closed"), closed).otherwise(opened).alias("score"))
    return scores.groupBy(asset).agg(F.max("score").alias("score")).orderBy(F.desc("score"), asset).limit(max(1, min(k, TOP_MAX)))


def _buckets(n: Column) -> Column:
    """Vertex counts by factors: shapes alike enough to match differ by less than half."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(0.4))


def shape_matches(df: DataFrame, least: float = geometry.MATCH, asset: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, rows by class): which classes of equal shapes are alike at least so much.

    Equal feature rows are one class, met by closedness and neighbouring buckets of vertex counts, so a
    shape that recurs in many assets meets others once.
    """
    named = df.withColumn("class", F.xxhash64(*FEATURES, "closed"))
    classes = named.groupBy("class").agg(*(F.first(c).alias(c) for c in [*FEATURES, "closed"])).withColumn("bucket", _buckets(F.col("vertices")))
    left = classes.select(*(F.col(c).alias(f"l_{c}") for c in classes.columns)).withColumn("bucket", F.explode(F.array(*(F.col("l_bucket") + d for d in (-2, -1, 0, 1, 2)))))
    pairs = left.join(classes, (left["bucket"] == classes["bucket"]) & (F.col("l_closed") == F.col("closed")))
    alike = pairs.filter(geometry.shape_similarity(_columns("l_"), _columns()) >= least).select(F.col("l_class").alias("ca"), F.col("class").alias("cb"))
    return alike, named.select(asset, "shape_id", "class")


def overlap_scores(df: DataFrame, least: int = 1, asset: str = "asset_id") -> DataFrame:
    """(a, b, score): rounded percentage of two assets' shapes that match one of the other's.

    Counts run over classes of equal shapes an asset has, with how many there are of each.
    """
    alike, members = shape_matches(df, asset=asset)
    have = members.groupBy(asset, "class").agg(F.count(F.lit(1)).alias("n"))
    totals = have.groupBy(asset).agg(F.sum("n").alias("total"))
    a = have.select(F.col(asset).alias("a"), F.col("class").alias("ca"), F.col("n").alias("na"))
    b = have.select(F.col(asset).alias("b"), F.col("class").alias("cb"))
    matched = a.join(alike, "ca").join(b, "cb").filter("a != b").select("a", "b", "ca", "na").distinct().groupBy("a", "b").agg(F.sum("na").alias("m"))
    back = matched.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("m").alias("mb"))
    both = matched.filter("a < b").join(back, ["a", "b"])
    for side in ("a", "b"):
        both = both.join(totals.select(F.col(asset).alias(side), F.col("total").alias(f"t{side}")), side)
    return both.select("a", "b", F.round((F.col("m") + F.col("mb")) * 100.0 / (F.col("ta") + F.col("tb"))).cast("int").alias("score")).filter(F.col("score") >= max(1, least))


def composite_search(df: DataFrame, refs: DataFrame, least: int = 0, k: int = TOP, asset: str = "asset_id") -> DataFrame:
    """(ref, asset, score, rank): for each asset of refs, the k others whose shapes overlap its own most.

    The score is the share of both assets' shapes that match one of the other's, 0 to 1, from a rounded
    percentage. Only classes of shapes that some reference has are compared with all others.
    """
    named = df.withColumn("class", F.xxhash64(*FEATURES, "closed"))
    have = materialize(named.groupBy(asset, "class").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in [*FEATURES, "closed"])), "shape-classes")
    own = have.join(refs.select(F.col(asset).alias("__ref")).distinct(), F.col(asset) == F.col("__ref"), "left_semi")
    features = [*FEATURES, "closed"]
    one = lambda rows: rows.dropDuplicates(["class"]).select("class", *features).withColumn("bucket", _buckets(F.col("vertices")))
    left = one(own).select(F.col("class").alias("ca"), *(F.col(c).alias(f"l_{c}") for c in features), F.explode(F.array(*(F.col("bucket") + d for d in (-2, -1, 0, 1, 2)))).alias("bucket"))
    alike = left.join(one(have), "bucket").filter(geometry.shape_similarity(_columns("l_"), _columns()) >= geometry.MATCH).select("ca", F.col("class").alias("cb"))
    a = own.select(F.col(asset).alias("ref"), F.col("class").alias("ca"), F.col("n").alias("na"))
    b = have.select(F.col(asset).alias("asset"), F.col("class").alias("cb"), F.col("n").alias("nb"))
    # Which classes of either side match, by pair of assets; each side's are summed once.
    met = materialize(a.join(alike, "ca").join(b, "cb").filter("ref <> asset"), "shape-matches")
    sides = met.select("ref", "asset", "ca", F.col("na").alias("n")).distinct().unionByName(met.select("ref", "asset", F.col("cb").alias("ca"), F.col("nb").alias("n"), F.lit(1).alias("side")).distinct(), allowMissingColumns=True)
    matched = sides.groupBy("ref", "asset").agg(F.sum("n").alias("m"))
    totals = have.groupBy(asset).agg(F.sum("n").alias("total"))
    for side in ("ref", "asset"):
        matched = matched.join(totals.select(F.col(asset).alias(side), F.col("total").alias(f"t_{side}")), side)
    score = F.round(F.col("m") * 100.0 / (F.col("t_ref") + F.col("t_asset"))).cast("int")
    scored = matched.select("ref", "asset", score.alias("score")).filter(F.col("score") >= max(1, min(least, 100)))
    place = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("score"), "asset"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= max(1, min(k, TOP_MAX))).withColumn("score", F.col("score") / 100.0)


def structural_groups(df: DataFrame, least: int = 60, asset: str = "asset_id") -> DataFrame:
    """(id, component, score): assets linked by overlaps, scored by the weakest link."""
    edges = overlap_scores(df, least, asset)
    nodes = connected_components(edges, "a", "b")
    weakest = edges.join(nodes.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.min("score").alias("score"))
    return nodes.join(weakest, "component").select(F.col("node").alias("id"), "component", "score")
