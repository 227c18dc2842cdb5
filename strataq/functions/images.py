"""Numeric kernels over decoded images, and headers of undecoded ones; used in Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import MATRIX, WHITE

#: Side of the reduced image and of the kept frequencies, colours and rounds of k-means.
SIDE, KEPT, COLORS, ROUNDS = 32, 8, 5, 20


def shrink(gray: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Mean of the cells of a side x side grid."""
    rows = np.linspace(0, gray.shape[0], side + 1).astype(int)
    columns = np.linspace(0, gray.shape[1], side + 1).astype(int)
    return np.array([[gray[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(columns, columns[1:])] for a, b in zip(rows, rows[1:])])


def perceptual_hash(gray: np.ndarray) -> int:
    """63 bits: which low frequencies of the cosine transform, the mean aside, exceed their median."""
    n = np.arange(SIDE)
    basis = np.cos(np.pi / SIDE * (n[None, :] + 0.5) * n[:KEPT, None])
    low = (basis @ shrink(gray.astype(float)) @ basis.T).ravel()[1:]
    return int(sum(1 << i for i, b in enumerate(low > np.median(low)) if b))


def to_lab(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255.0
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = c @ np.array(MATRIX).T / np.array(WHITE)
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack((116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])), 1)


def dominant_colors(rgb: np.ndarray, k: int = COLORS) -> list[dict]:
    """Means of k-means clusters in Lab, started far from each other, by falling share."""
    points = rgb.reshape(-1, 3).astype(float)
    lab = to_lab(points)
    centres = [lab.mean(0)]
    while len(centres) < min(k, len(np.unique(points, axis=0))):
        centres.append(lab[np.argmax(np.min([((lab - c) ** 2).sum(1) for c in centres], axis=0))])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        own = np.argmin(((lab[:, None] - centres[None]) ** 2).sum(2), axis=1)
        new = np.array([lab[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(new, centres):
            break
        centres = new
    out = [{**dict(zip("rgb", (int(round(x)) for x in points[own == i].mean(0)))), "percentage": float((own == i).mean() * 100)} for i in range(len(centres)) if (own == i).any()]
    return sorted(out, key=lambda c: -c["percentage"])


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by the header of a PNG, GIF, BMP or JPEG file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


def size_column(content: Column) -> Column:
    """struct<width, height> of image bytes; null where no header is known."""

    @F.pandas_udf("width int, height int")
    def run(s: pd.Series) -> pd.DataFrame:
        found = [image_size(bytes(x)) if x is not None else None for x in s]
        return pd.DataFrame({"width": [f[0] if f else None for f in found], "height": [f[1] if f else None for f in found]}, dtype="Int32")

    return run(content)


def hash_column(pixels: Column, width: Column) -> Column:
    """Perceptual hashes of grey images, given as their samples and width."""

    @F.pandas_udf("long")
    def run(s: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not n or not len(x) else perceptual_hash(np.frombuffer(x, np.uint8).reshape(-1, int(n))) for x, n in zip(s, w)], dtype="Int64")

    return run(pixels, width)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The corners of the hull, counter-clockwise."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(order: np.ndarray) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array([*half(points), *half(points[::-1])])


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


#: Side of a model's image, and mean and deviation of its channels.
MODEL_SIDE = 224
MEAN, DEVIATION = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic kernel through its points (Catmull-Rom)."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def resampling(size: int, wanted: int) -> np.ndarray:
    """(wanted, size) weights of a line's samples: the kernel is widened when the line shrinks."""
    ratio = size / wanted
    wide = max(ratio, 1.0)
    centre = (np.arange(wanted) + 0.5) * ratio
    low = np.clip(np.floor(centre - 2 * wide), 0, size - 1)[:, None]
    high = np.clip(np.ceil(centre + 2 * wide), low[:, 0] + 1, size)[:, None]
    at = np.arange(size)[None, :]
    weights = np.where((at >= low) & (at < high), _cubic((at - (centre - 0.5)[:, None]) / wide), 0.0)
    return weights / weights.sum(1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """(height, width, channels) samples by two matrix products, rounded and kept within 0 to 255."""
    across = np.einsum("yh,hwc->ywc", resampling(pixels.shape[0], height), pixels.astype(np.float64))
    both = np.einsum("xw,ywc->yxc", resampling(pixels.shape[1], width), across)
    return np.floor(np.clip(both, 0, 255) + 0.5).clip(0, 255).astype(np.uint8)


def model_input(pixels: np.ndarray, region: tuple[int, int, int] | None = None, side: int = MODEL_SIDE) -> np.ndarray:
    """(3, side, side) normalised samples: the shorter side scaled to side and the middle cut out, or a square
    region (x, y, length) scaled whole; a region beyond the image is an error."""
    pixels = np.broadcast_to(pixels, (*pixels.shape[:2], 3))
    h, w = pixels.shape[:2]
    if not h or not w:
        raise ValueError("an empty image")
    if region is None:
        wide, high = (side, int(np.floor(h * side / w + 0.5))) if w < h else (int(np.floor(w * side / h + 0.5)), side)
        scaled = resize(pixels, max(wide, side), max(high, side))
        x, y = (scaled.shape[1] - side) // 2, (scaled.shape[0] - side) // 2
        scaled = scaled[y : y + side, x : x + side]
    else:
        x, y, length = region
        length = min(length, w - x, h - y)
        if x < 0 or y < 0 or length < 1:
            raise ValueError("a region beyond the image")
        scaled = resize(pixels[y : y + length, x : x + length], side, side)
    return ((scaled.astype(np.float32) / np.float32(255) - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)).transpose(2, 0, 1)
