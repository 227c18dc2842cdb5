"""Image files as rows: size, camera data and place from the first bytes, and pixels of plain formats.

Camera data are linked directories of typed entries in either byte order; only the bytes they need are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contours, images
from .readers import scan

#: Marks of rendering programs, tags by name, bytes of a value by type.
RENDERERS = ["vray", "v-ray", "corona", "lumion", "enscape", "3ds max", "blender", "cinema 4d", "maya", "sketchup", "unreal", "unity", "octane", "redshift", "arnold", "cycles", "eevee", "keyshot", "twinmotion"]
TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0131: "software", 0x9003: "date_taken", 0xA001: "color_space", 0x920A: "focal_length", 0x829A: "exposure_time", 0x8827: "iso_speed"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
CAMERA, PLACE = 0x8769, 0x8825
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
IMAGE_KINDS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "gif", "webp", "pgm", "ppm"]
#: Bytes that are read first; entries of a directory and bytes of a value at most (more is a broken file).
HEAD, ENTRIES, VALUE = 1 << 16, 4096, 1 << 16
#: Pixels of an image that is decoded, at most.
MAX_PIXELS = 100_000_000

Read = Callable[[int, int], bytes]


def ranged(file, size: int) -> Read:
    """Reads of (offset, length) of an open file, the first HEAD bytes once."""
    head = file.read_at(min(HEAD, size), 0)

    def read(at: int, n: int) -> bytes:
        if at < 0 or at >= size or n <= 0:
            return b""
        if at + n <= len(head):
            return head[at : at + n]
        return file.read_at(min(n, size - at), at)

    return read


def of_bytes(data: bytes) -> Read:
    return lambda at, n: data[at : at + n] if at >= 0 and n > 0 else b""


def exif_base(read: Read) -> int | None:
    """Where a file's camera data begin: in a JPEG's or WebP's own part, a PNG's chunk, or a TIFF itself."""
    start = read(0, 12)
    if start[:4] in (b"II*\0", b"MM\0*"):
        return 0
    if start[:2] == b"\xff\xd8":
        at = 2
        while len(mark := read(at, 10)) == 10 and mark[0] == 0xFF and mark[1] != 0xDA:
            if mark[1] == 0xE1 and mark[4:10] == b"Exif\0\0":
                return at + 10
            at += 2 + struct.unpack(">H", mark[2:4])[0]
    elif start[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while len(chunk := read(at, 8)) == 8:
            if chunk[4:] == b"eXIf":
                return at + 8
            at += 12 + struct.unpack(">I", chunk[:4])[0]
    elif start[:4] == b"RIFF" and start[8:] == b"WEBP":
        at = 12
        while len(chunk := read(at, 14)) >= 8:
            if chunk[:4] == b"EXIF":
                return at + (14 if chunk[8:14] == b"Exif\0\0" else 8)
            size = struct.unpack("<I", chunk[4:8])[0]
            at += 8 + size + size % 2
    return None


def _values(read: Read, base: int, order: str, kind: int, count: int, field: bytes) -> list | str | None:
    """An entry's values; None where its type or place is broken."""
    size = SIZES.get(kind, 0) * count
    if not size or size > VALUE:
        return None
    raw = field[:size] if size <= 4 else read(base + struct.unpack(order + "I", field)[0], size)
    if len(raw) < size:
        return None
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        flat = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
        return [Fraction(a, b) if b else None for a, b in zip(flat[::2], flat[1::2])]
    code = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}[kind]
    return list(struct.unpack(f"{order}{count}{code}", raw))


def directory(read: Read, base: int, order: str, at: int) -> dict[int, list | str]:
    """The entries of one directory by tag, the first of each; broken ones are left out."""
    raw = read(base + at, 2)
    n = struct.unpack(order + "H", raw)[0] if len(raw) == 2 else 0
    out: dict[int, list | str] = {}
    if n > ENTRIES:
        return out
    block = read(base + at + 2, 12 * n)
    for i in range(len(block) // 12):
        tag, kind, count = struct.unpack_from(order + "HHI", block, 12 * i)
        value = _values(read, base, order, kind, count, block[12 * i + 8 : 12 * i + 12])
        if value is not None:
            out.setdefault(tag, value)
    return out


def _said(tag: int, value: list | str) -> str | None:
    """A value as people write it: text as it is, a short exposure as 1/n, other numbers in decimals."""
    if isinstance(value, str):
        return (value[:10].replace(":", "-") + value[10:] if tag == 0x9003 and value[4:5] == ":" else value) or None
    first = value[0] if value else None
    if first is None:
        return None
    if tag == 0xA001:
        return {1: "sRGB", 65535: "uncalibrated"}.get(first, str(first))
    if tag == 0x829A and 0 < first < 1:
        return f"1/{float(1 / first):.6g}"
    return f"{float(first):.6g}" if isinstance(first, (Fraction, float)) else str(first)


def degrees(parts: list | str | None, side: list | str | None) -> float | None:
    """Signed degrees from degrees, minutes and seconds, negative to the south and west."""
    if not isinstance(parts, list) or len(parts) < 3 or not all(isinstance(p, Fraction) for p in parts[:3]) or not isinstance(side, str):
        return None
    value = float(parts[0]) + float(parts[1]) / 60 + float(parts[2]) / 3600
    return -value if "S" in side or "W" in side else value


def camera_fields(read: Read) -> dict[str, str | float | bool]:
    """What an image says of its making: make, model, program, date, exposure, place; nothing if it says nothing."""
    base = exif_base(read)
    head = read(base, 8) if base is not None else b""
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or len(head) < 8:
        return {}
    first = directory(read, base, order, struct.unpack(order + "I", head[4:])[0])
    linked = lambda tag: directory(read, base, order, first[tag][0]) if isinstance(first.get(tag), list) else {}
    found = first | linked(CAMERA)
    out: dict = {name: said for tag, name in TAGS.items() if tag in found and (said := _said(tag, found[tag])) is not None}
    place = {name: value for tag, value in linked(PLACE).items() if (name := GPS_TAGS.get(tag))}
    for name in ("lat", "lon"):
        if (value := degrees(place.get(name), place.get(f"{name}_ref"))) is not None:
            out[f"gps_{name}"] = value
    if "software" in out:
        out["is_render"] = any(mark in out["software"].lower() for mark in RENDERERS)
    return out


FIELDS = {"camera_make": "string", "camera_model": "string", "software": "string", "date_taken": "string", "color_space": "string", "focal_length": "string", "exposure_time": "string", "iso_speed": "string", "gps_lat": "double", "gps_lon": "double", "is_render": "boolean"}


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_name, ext, width, height, camera fields, error) of the images below a root.

    Files are opened where they lie; a task reads the first HEAD bytes of each, and further ranges only where
    a directory points beyond them.
    """
    names = ["width", "height", *FIELDS, "error"]

    def one(path: str) -> tuple:
        try:
            files, at = pafs.FileSystem.from_uri(path)
            with files.open_input_file(at) as file:
                read = ranged(file, file.size())
                size = images.image_size(read(0, HEAD)) or (None, None)
                said = camera_fields(read)
            return (*size, *(said.get(c) for c in FIELDS), None)
        except Exception as e:  # one bad file is a row
            return (*[None] * (len(names) - 1), f"{type(e).__name__}: {e}"[:500])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = pd.DataFrame([one(p) for p in frame["path"]], columns=names, index=frame.index)
            yield pd.concat((frame, rows.astype({"width": "Int64", "height": "Int64"})), axis=1)

    files = scan(spark, root).filter("skipped is null").filter(F.col("ext").isin(IMAGE_KINDS))
    rows = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "file_name", "ext", "size_bytes")
    kinds = ", ".join(f"{k} {t}" for k, t in FIELDS.items())
    return rows.mapInPandas(run, f"path string, file_name string, ext string, size_bytes long, width int, height int, {kinds}, error string")


def metadata_rows(headers: DataFrame, asset: str = "path") -> DataFrame:
    """(asset_id, key, value_text, value_num) of what the headers say; a place under latitude and longitude."""
    named = {"gps_lat": "latitude", "gps_lon": "longitude"}
    pairs = F.array(*(F.struct(F.lit(named.get(c, c)).alias("key"), F.col(c).cast("string").alias("value_text"), (F.col(c) if t == "double" else F.lit(None)).cast("double").alias("value_num")) for c, t in FIELDS.items()))
    return headers.select(F.col(asset).alias("asset_id"), F.explode(pairs).alias("x")).select("asset_id", "x.*").filter("value_text is not null")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """PNG rows without their filters; the first byte of each row names its filter."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for y, row in enumerate(rows, 1):
        kind, line, above, own = int(row[0]), row[1:], out[y - 1], out[y]
        if kind == 0:
            own[:] = line
        elif kind == 1:
            for c in range(step):
                own[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            own[:] = line + above
        else:
            a, b = [0] * step, [0] * step
            values, up, new = line.tolist(), above.tolist(), []
            for i, v in enumerate(values):
                left, upper, corner = a[i % step], up[i], b[i % step]
                if kind == 3:
                    v = (v + (left + upper) // 2) & 255
                else:
                    p = left + upper - corner
                    near = min((abs(p - left), 0, left), (abs(p - upper), 1, upper), (abs(p - corner), 2, corner))[2]
                    v = (v + near) & 255
                a[i % step], b[i % step] = v, upper
                new.append(v)
            own[:] = new
    return out[1:]


def _decode_png(data: bytes) -> np.ndarray:
    at, packed, palette = 8, [], None
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        elif kind == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or laced or width * height > MAX_PIXELS:
        raise ValueError("only plain images of 8 bits a sample are decoded")
    rows = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), height * (width * channels + 1)), np.uint8)
    pixels = _unfiltered(rows.reshape(height, -1), channels).reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if colour == 3 else pixels[:, :, : 3 if channels > 2 else 1]


def _decode_bmp(data: bytes) -> np.ndarray:
    start, (width, height), bits, packed = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0], struct.unpack("<I", data[30:34])[0]
    if bits not in (24, 32) or packed not in (0, 3) or width * abs(height) > MAX_PIXELS:
        raise ValueError("only plain images of 24 or 32 bits are decoded")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return rows if height < 0 else rows[::-1]


def _decode_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        end = at
        while data[end : end + 1].isspace():
            end += 1
        if data[end : end + 1] == b"#":
            at = data.index(b"\n", end)
            continue
        at = end
        while not data[at : at + 1].isspace():
            at += 1
        fields.append(int(data[end:at]))
    width, height, most = fields
    channels = 3 if data[:2] == b"P6" else 1
    if most > 255 or width * height > MAX_PIXELS:
        raise ValueError("only images of 8 bits a sample are decoded")
    return np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)


def decode_image(data: bytes) -> np.ndarray:
    """(height, width, 1 or 3) samples of a PNG, BMP, PGM or PPM file; an error for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _decode_png(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:2] in (b"P5", b"P6"):
        return _decode_pnm(data)
    raise ValueError("no decoder for this format")


def to_gray(pixels: np.ndarray) -> np.ndarray:
    return pixels[:, :, 0] if pixels.shape[2] == 1 else (pixels @ np.array([0.2126, 0.7152, 0.0722])).round().astype(np.uint8)


VISUAL = "path string, width int, height int, phash long, dominant_colors array<struct<r:int,g:int,b:int,percentage:double>>, contour_points int, points array<struct<x:double,y:double>>, error string"


def read_visuals(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, phash, dominant_colors, contour_points, points, error): what images below a root look like.

    An image is decoded once, by itself; its outline is missing where it has none. Formats without a decoder
    are rows with an error.
    """

    def one(path: str, data: bytes | None) -> tuple:
        try:
            pixels = decode_image(data)
            gray = to_gray(pixels)
            thin = pixels[:: -(-pixels.shape[0] // 64), :: -(-pixels.shape[1] // 64)]
            colours = images.dominant_colors(np.broadcast_to(thin, (*thin.shape[:2], 3)))
            try:
                corners, n = contours.outline(gray)
                points = [{"x": float(x), "y": float(y)} for x, y in corners]
            except ValueError:
                n, points = None, None
            return path, pixels.shape[1], pixels.shape[0], images.perceptual_hash(gray), colours, n, points, None
        except Exception as e:  # one bad file is a row
            return path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):  # an image at a time
                out = pd.DataFrame([one(path, content)], columns=[x.split()[0] for x in VISUAL.split(", ")])
                yield out.astype({c: "Int64" for c in ("width", "height", "phash", "contour_points")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = files.filter(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_KINDS)})$") & (F.col("length") <= 4 * MAX_PIXELS))
    return wanted.select("path", "content").mapInPandas(run, VISUAL)
