"""Outlines of images: threshold, border following and line simplification, in Arrow batches.

A grey image is split by the threshold of greatest between-class variance; on a light ground what is dark is
the drawing, on a dark one what is light. Borders are followed around each part by its eight neighbours, the
longest one is simplified to its corners, and these feed the features of outlines (operators.shapes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import convex_hull

#: Share of the longer side that a simplified line may be off, mean from which a ground is light,
#: points from which the farthest pair is looked for among every so many, and how many these are.
TOLERANCE, LIGHT, MANY, AMONG = 0.015, 128, 2000, 500
#: Images whose outlines a task holds at once.
IMAGES = 256
#: Neighbours clockwise from the right one (y grows downward), and the way first looked when a border begins.
STEPS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
FIRST, BACK = 6, 5


def otsu_threshold(gray: np.ndarray) -> int:
    """The least grey value whose split has the greatest variance between both sides; 0 if none splits."""
    n = np.bincount(gray.ravel(), minlength=256)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    inner = (below > 0) & (below < below[-1])
    if not inner.any():
        return 0
    a = below[inner]
    apart = (sums[inner] * below[-1] - sums[-1] * a).astype(float)  # of whole numbers, so that ties are ties
    between = apart * apart / (a * (below[-1] - a)).astype(float)
    return int(np.flatnonzero(inner)[np.argmax(between)]) if between.max() > 0 else 0


def foreground(gray: np.ndarray) -> np.ndarray:
    """Which pixels are the drawing."""
    dark = gray <= otsu_threshold(gray)
    return dark if gray.size and gray.mean() >= LIGHT else ~dark


def _ways() -> np.ndarray:
    """For each set of neighbours (8 bits) and way of coming: the next way clockwise from BACK on, -1 without any."""
    out = np.full((256, 8), -1, np.int8)
    for mask in range(1, 256):
        for way in range(8):
            out[mask, way] = next((way + BACK + k) % 8 for k in range(8) if mask >> (way + BACK + k) % 8 & 1)
    return out


_NEXT = _ways()


def neighbour_masks(inside: np.ndarray) -> np.ndarray:
    """8 bits a pixel: which of its neighbours, in the order of STEPS, are inside."""
    h, w = inside.shape
    framed = np.zeros((h + 2, w + 2), np.uint8)
    framed[1:-1, 1:-1] = inside
    out = np.zeros((h, w), np.uint8)
    for bit, (dx, dy) in enumerate(STEPS):
        out |= framed[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] << bit
    return out


def longest_border(inside: np.ndarray) -> np.ndarray:
    """(n, 2) x and y of the longest border, the first of equally long ones; each ends back at its start."""
    h, w = inside.shape
    masks = neighbour_masks(inside)
    starts = np.flatnonzero((inside & (masks != 255)).ravel()).tolist()
    flat, jump = masks.ravel().tolist(), [dx + dy * w for dx, dy in STEPS]
    ways = _NEXT.tolist()
    seen, best = bytearray(h * w), []
    for start in starts:
        if seen[start]:
            continue
        at, way, border = start, FIRST, []
        for _ in range(2 * h * w + 1):
            border.append(at)
            seen[at] = 1
            way = ways[flat[at]][way]
            if way < 0:
                break
            at += jump[way]
            if at == start:
                break
        if len(border) > len(best):
            best = border
    found = np.array(best, np.int64)
    return np.stack((found % w, found // w), 1) if len(best) else np.empty((0, 2), np.int64)


def _farthest_pair(points: np.ndarray) -> tuple[int, int]:
    """Places of the farthest points; of equal distances the first in order. They are corners of the hull."""
    step = max(1, len(points) // AMONG) if len(points) > MANY else 1
    some = points[::step]
    values, first = np.unique(some, axis=0, return_index=True)
    corners = convex_hull(values)
    at = np.sort([first[np.flatnonzero((values == c).all(1))[0]] for c in corners])
    square = ((some[at][:, None] - some[at][None]) ** 2).sum(2)
    i, j = np.unravel_index(np.argmax(square), square.shape)
    return int(at[i]) * step, int(at[j]) * step


def _corners(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an open line stay: its ends, and what is farthest off by more than the tolerance, again and again."""
    kept = np.zeros(len(line), bool)
    kept[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (x1, y1), (x2, y2) = line[a], line[b]
        dx, dy = x2 - x1, y2 - y1
        x, y = line[a + 1 : b, 0], line[a + 1 : b, 1]
        long = dx * dx + dy * dy
        off = np.hypot(x - x1, y - y1) if long < 1e-12 else np.abs(dy * x - dx * y + x2 * y1 - y2 * x1) / np.sqrt(long)
        far = int(np.argmax(off))
        if off[far] > tolerance:
            kept[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return kept


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed line's corners: it is cut at its farthest points, and each half is simplified."""
    if len(points) <= 3:
        return points
    points = points.astype(float)
    a, b = _farthest_pair(points)
    halves = [points[a : b + 1], np.concatenate((points[b:], points[: a + 1]))]
    return np.concatenate([half[_corners(half, tolerance)][: -1 if len(half) > 1 else None] for half in halves])


def outline(gray: np.ndarray) -> tuple[np.ndarray, int]:
    """(corners, points of the border) of a grey image's longest outline; an error if there is none."""
    border = longest_border(foreground(gray)) if gray.size else np.empty((0, 2))
    if len(border) < 3:
        raise ValueError("no outline of three points")
    corners = simplify(border, max(gray.shape) * TOLERANCE)
    if len(corners) < 3:
        raise ValueError("fewer than three corners are left")
    return corners, len(border)


def outlines(df: DataFrame, pixels: str, width: str, key: list[str]) -> DataFrame:
    """(key, image_width, image_height, threshold, drawn, contour_points, points, error) of grey images.

    pixels: samples row by row, as binary or an array of 0 to 255; points: array of (x, y), the outline's corners,
    ready for shapes.outline_features. drawn: pixels of the drawing. Null or ragged images are rows with an error.
    """

    def one(samples, w) -> tuple:
        if not samples.is_valid or not w or w < 1:
            return None, None, None, None, None, None, "no image"
        flat = np.frombuffer(samples.as_buffer(), np.uint8) if isinstance(samples, pa.BinaryScalar) else samples.values.to_numpy(zero_copy_only=False)
        if len(flat) % int(w) or not len(flat):
            return None, None, None, None, None, None, "samples do not fill its rows"
        gray = flat.astype(np.uint8).reshape(-1, int(w))
        found = (gray.shape[1], gray.shape[0], otsu_threshold(gray), int(foreground(gray).sum()))
        try:
            corners, n = outline(gray)
        except ValueError as e:
            return *found, None, None, str(e)
        return *found, n, corners, None

    names = ["image_width", "image_height", "threshold", "drawn", "contour_points", "points", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, IMAGES):
                part = batch.slice(at, IMAGES)
                found = list(zip(*(one(s, w) for s, w in zip(part.column("__pixels"), part.column("__width").to_pylist()))))
                lines = found[5]
                ends = np.cumsum([0, *(0 if p is None else len(p) for p in lines)])
                flat = np.concatenate([np.empty((0, 2)), *(p for p in lines if p is not None)]).astype(float)
                corners = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
                offsets = pa.array(ends.astype(np.int32), mask=np.array([*(p is None for p in lines), False]))
                columns = [*(part.column(c) for c in key), *(pa.array(found[i], pa.int32()) for i in range(5)), pa.ListArray.from_arrays(offsets, corners), pa.array(found[6], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, *names])

    rows = df.select(*key, F.col(pixels).alias("__pixels"), F.col(width).cast("long").alias("__width"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    return rows.mapInArrow(run, f"{kinds}, image_width int, image_height int, threshold int, drawn int, contour_points int, points array<struct<x:double,y:double>>, error string")
