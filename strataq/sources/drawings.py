"""Shapes of drawings: each file gives a row per line, circle, arc and polyline.

A file is read as a stream of (code, value) pairs; only the entity that is open is held. Features are
computed by Spark from the rows' points, so a task's Python reads and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes
from .readers import decode, scan

#: Rows that a task hands on at once.
BATCH = 4096
_NUMBERS = {"LINE": (10, 20, 11, 21), "CIRCLE": (10, 20, 40), "ARC": (10, 20, 40, 50, 51)}
ROWS = "path string, shape_id int, entity_type string, layer_name string, is_closed boolean, points array<struct<x:double,y:double>>, radius double, sweep double, error string"


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def pairs_of(lines: Iterable[bytes]) -> Iterator[tuple[int, str]]:
    """(code, value) pairs; lines that are no code where one is due are skipped."""
    lines = iter(lines)
    for line in lines:
        try:
            code = int(line)
        except ValueError:
            continue
        value = next(lines, None)
        if value is None:
            return
        yield code, decode(value.strip())[0]


class _Entity:
    """The open entity: its kind, layer, flags and numbers, and the vertices of a polyline."""

    def __init__(self, kind: str):
        self.kind, self.layer, self.flags = kind, "0", 0
        self.values: dict[int, float | None] = {}
        self.points: list[tuple[float, float]] = []
        self.x: float | None = None  # of a vertex whose y is still to come
        self.vertex: dict[int, float | None] | None = None

    def add(self, code: int, value: str) -> None:
        if self.vertex is not None:
            if code in (10, 20):
                self.vertex[code] = _number(value)
        elif code == 8:
            self.layer = value
        elif code == 70:
            self.flags = int(value) if value.lstrip("+-").isdigit() else 0
        elif self.kind == "LWPOLYLINE":
            if code == 10:
                if self.x is not None:
                    self.points.append((self.x, 0.0))
                self.x = _number(value)
            elif code == 20:
                y = _number(value)
                if self.x is not None and y is not None:
                    self.points.append((self.x, y))
                self.x = None
        else:
            self.values[code] = _number(value)

    def end_vertex(self) -> None:
        if self.vertex is not None and None not in (self.vertex.get(10), self.vertex.get(20)):
            self.points.append((self.vertex[10], self.vertex[20]))
        self.vertex = None

    def row(self) -> tuple | None:
        """(entity_type, layer_name, is_closed, points, radius, sweep in degrees); None if something is missing."""
        if self.kind in _NUMBERS:
            values = [self.values.get(c) for c in _NUMBERS[self.kind]]
            if None in values:
                return None
            if self.kind == "LINE":
                return self.kind, self.layer, False, [tuple(values[:2]), tuple(values[2:])], None, None
            if values[2] <= 0:
                return None
            sweep = values[4] - values[3] if self.kind == "ARC" else 360.0
            if not 0 <= sweep <= 360:
                sweep = sweep % 360 or 360.0 * (sweep > 0)
            return self.kind, self.layer, self.kind == "CIRCLE", [tuple(values[:2])], values[2], sweep
        return (self.kind, self.layer, bool(self.flags & 1), self.points, None, None) if self.points else None


def shapes_of(lines: Iterable[bytes]) -> Iterator[tuple]:
    """The shapes of a drawing's entity section in order."""
    inside, now = False, None
    for code, value in pairs_of(lines):
        if code == 0:
            if now is not None and now.kind == "POLYLINE" and value == "VERTEX":
                now.end_vertex()
                now.vertex = {}
                continue
            if now is not None:
                now.end_vertex()
                if (row := now.row()) is not None:
                    yield row
            now = None
            inside = inside and value != "ENDSEC"
            if inside and value in (*_NUMBERS, "LWPOLYLINE", "POLYLINE"):
                now = _Entity(value)
        elif code == 2 and value == "ENTITIES" and now is None:
            inside = True
        elif now is not None:
            now.add(code, value)
    if now is not None:
        now.end_vertex()
        if (row := now.row()) is not None:
            yield row


def read_shapes(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all shapes in the drawings (dxf) below a root; a file that cannot be read is a row with an error.

    Files are dealt by path and streamed; a task holds BATCH rows, however large the file is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        held: list[tuple] = []
        for frame in frames:
            for path in frame["path"]:
                try:
                    files, at = pafs.FileSystem.from_uri(path)
                    with files.open_input_stream(at, buffer_size=1 << 20) as stream:
                        for i, (kind, layer, closed, points, radius, sweep) in enumerate(shapes_of(_lines(stream))):
                            held.append((path, i, kind, layer, closed, [{"x": x, "y": y} for x, y in points], radius, sweep, None))
                            if len(held) >= BATCH:
                                yield pd.DataFrame(held, columns=names)
                                held = []
                except Exception as e:  # one bad file is a row
                    held.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
        yield pd.DataFrame(held, columns=names)

    files = scan(spark, root).filter("skipped is null and ext = 'dxf'").select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return files.mapInPandas(run, ROWS)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def with_features(rows: DataFrame) -> DataFrame:
    """Shapes with their features: polygons by outline_features; of a circle those are known, an arc has its length."""
    out = shapes.outline_features(rows.filter("error is null"), "points", "is_closed")
    circle, arc = F.col("entity_type") == "CIRCLE", F.col("entity_type") == "ARC"
    round_ = circle | arc
    mean = lambda k: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[k]) / F.size("points")
    width, height = shapes.geometry.box(F.col("points"))
    known = {"area": F.when(circle, math.pi * F.col("radius") * F.col("radius")), "perimeter": F.when(round_, F.col("radius") * F.radians("sweep")), "aspect": F.when(round_, 1.0)}
    known |= {k: F.when(circle, 1.0) for k in ("regularity", "compactness", "solidity")}
    known |= {"rectangularity": F.when(circle, math.pi / 4), "box_width": F.when(round_, 2 * F.col("radius")).otherwise(width), "box_height": F.when(round_, 2 * F.col("radius")).otherwise(height)}
    out = out.withColumns({k: F.coalesce(v, F.col(k)) if k in out.columns else v for k, v in known.items()})
    return out.withColumns({"centroid_x": mean("x"), "centroid_y": mean("y"), "closed": F.col("is_closed"), "category": shapes.layer_category(F.col("layer_name"))})
