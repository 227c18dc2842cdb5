"""Geometry expressions: polygons as arrays of (x, y), shapes by their features, places."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .images import convex_hull

#: Weights of closed, open and mixed shape comparisons.
CLOSED = {"vertices": 0.20, "compactness": 0.20, "regularity": 0.15, "aspect": 0.15, "rectangularity": 0.15, "solidity": 0.10, "constant": 0.05}
OPEN = {"aspect": 0.35, "vertices": 0.30, "regularity": 0.25, "constant": 0.10}
MATCH = 0.9


def _edges(points: Column) -> Column:
    """Each point with the next one, the last with the first."""
    turned = F.concat(F.slice(points, 2, 1 << 30), F.slice(points, 1, 1))
    return F.zip_with(points, turned, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def area(points: Column) -> Column:
    return F.abs(_sum(F.transform(_edges(points), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]))) / 2


def perimeter(points: Column, closed: bool = True) -> Column:
    edges = _edges(points)
    edges = edges if closed else F.slice(edges, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return _sum(F.transform(edges, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])))


def centroid(points: Column) -> tuple[Column, Column]:
    cross = F.transform(_edges(points), lambda e: F.struct((e["x1"] * e["y2"] - e["x2"] * e["y1"]).alias("c"), (e["x1"] + e["x2"]).alias("x"), (e["y1"] + e["y2"]).alias("y")))
    total = _sum(F.transform(cross, lambda c: c["c"])) * 3
    return tuple(_sum(F.transform(cross, lambda c: c[k] * c["c"])) / total for k in ("x", "y"))


def box(points: Column) -> tuple[Column, Column]:
    """Width and height of the bounding box."""
    side = lambda k: F.array_max(F.transform(points, lambda p: p[k])) - F.array_min(F.transform(points, lambda p: p[k]))
    return side("x"), side("y")


def _bound(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _variation(values: Column) -> Column:
    """struct<mean, spread>: the mean of an array, and its standard deviation by the mean."""
    off = lambda m: lambda v: (v - m["mean"]) * (v - m["mean"])
    means = lambda vs: F.struct(vs.alias("vs"), (_sum(vs) / F.size(vs)).alias("mean"))
    spread = lambda m: F.struct(m["mean"].alias("mean"), (F.sqrt(_sum(F.transform(m["vs"], off(m))) / F.size(m["vs"])) / m["mean"]).alias("spread"))
    return _bound(_bound(values, means), spread)


def regularity(points: Column) -> Column:
    """1 for equal edges and equal angles, falling to 0 with the variation of either; 0 below three corners."""
    n = F.size(points)
    lengths = F.transform(_edges(points), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))

    def angle(i: Column) -> Column:
        a, b, c = points[(i + n - 1) % n], points[i], points[(i + 1) % n]
        ax, ay, cx, cy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
        return F.abs(F.atan2(ax * cy - ay * cx, ax * cx + ay * cy))

    both = F.struct(_variation(lengths).alias("edge"), _variation(F.transform(F.sequence(F.lit(0), n - 1), angle)).alias("turn"))
    flat = lambda b: (b["edge"]["mean"] < 1e-9) | (b["turn"]["mean"] < 1e-9)
    value = _bound(both, lambda b: F.when(flat(b), 0.0).otherwise(F.exp(-2.0 * (b["edge"]["spread"] + b["turn"]["spread"]))))
    return F.when(n < 3, 0.0).otherwise(value)


def solidity(points: Column) -> Column:
    """The share of its convex hull that an outline fills."""

    @F.pandas_udf("double")
    def hull_area(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x, y) -> float:
            hull = convex_hull(np.stack((x, y), 1)) if x is not None and len(x) > 2 else np.empty((0, 2))
            return 0.0 if len(hull) < 3 else 0.5 * abs(float(np.dot(hull[:, 0], np.roll(hull[:, 1], -1)) - np.dot(hull[:, 1], np.roll(hull[:, 0], -1))))

        return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype=float)

    whole = hull_area(F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double")))
    return F.when((whole < 1e-9) | (area(points) < 1e-9), 0.0).otherwise(F.least(F.lit(1.0), area(points) / whole))


def compactness(a: Column, p: Column) -> Column:
    return F.when((p < 1e-9) | (a < 1e-9), 0.0).otherwise(F.least(F.lit(1.0), 4 * math.pi * a / (p * p)))


def rectangularity(points: Column) -> Column:
    w, h = box(points)
    return F.when((w * h < 1e-9) | (area(points) < 1e-9), 0.0).otherwise(F.least(F.lit(1.0), area(points) / (w * h)))


def near(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b))


def vertex_similarity(a: Column, b: Column) -> Column:
    sigma = F.greatest(0.3 * F.greatest(a, b), F.lit(1.5))
    return F.exp(-F.pow(a - b, F.lit(2.0)) / (2 * sigma * sigma))


def aspect_similarity(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) <= 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def shape_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Weighted likeness of two shapes' features; a closed and an open one share few of them."""
    parts = {"vertices": vertex_similarity(a["vertices"], b["vertices"]), "aspect": aspect_similarity(a["aspect"], b["aspect"]), "constant": F.lit(1.0)}
    parts |= {k: near(a[k], b[k]) for k in ("compactness", "regularity", "rectangularity", "solidity")}
    total = lambda weights: sum(w * parts[k] for k, w in weights.items())
    mixed = 0.30 * parts["vertices"] + 0.20 * parts["aspect"]
    return F.when(a["closed"] & b["closed"], total(CLOSED)).when(~a["closed"] & ~b["closed"], total(OPEN)).otherwise(mixed)


def place_distance2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared equirectangular distance, in degrees."""
    dx = (lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2))
    return dx * dx + (lat1 - lat2) * (lat1 - lat2)
