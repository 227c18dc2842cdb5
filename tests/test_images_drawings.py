"""Outlines, drawings' shapes and image files against plain versions and small files made here."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.functions import contours
from strataq.operators import classify, geo, shapes
from strataq.sources import drawings, images

WAYS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def plain_otsu(gray):
    best, at = 0, 0
    for t in range(256):
        low, high = gray[gray <= t].astype(float), gray[gray > t].astype(float)
        if len(low) and len(high) and (v := len(low) * len(high) * (low.mean() - high.mean()) ** 2) > best * (1 + 1e-12):
            best, at = v, t
    return at


def plain_border(inside):
    h, w = inside.shape
    there = lambda x, y: 0 <= x < w and 0 <= y < h and inside[y, x]
    seen, best = set(), []
    for y in range(h):
        for x in range(w):
            if not there(x, y) or (x, y) in seen or all(there(x + a, y + b) for a, b in WAYS):
                continue
            at, way, path = (x, y), 6, []
            for _ in range(2 * w * h + 1):
                path.append(at)
                seen.add(at)
                ways = [(way + 5 + k) % 8 for k in range(8)]
                way = next((d for d in ways if there(at[0] + WAYS[d][0], at[1] + WAYS[d][1])), None)
                if way is None:
                    break
                at = at[0] + WAYS[way][0], at[1] + WAYS[way][1]
                if at == (x, y):
                    break
            best = path if len(path) > len(best) else best
    return best


def plain_line(points, off):
    if len(points) <= 2:
        return points
    (x1, y1), (x2, y2) = points[0], points[-1]
    long = math.hypot(x2 - x1, y2 - y1)
    d = [abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / long if long > 1e-6 else math.hypot(x - x1, y - y1) for x, y in points[1:-1]]
    if max(d) <= off:
        return [points[0], points[-1]]
    i = d.index(max(d)) + 1
    return plain_line(points[: i + 1], off)[:-1] + plain_line(points[i:], off)


def plain_corners(points, off):
    if len(points) <= 3:
        return points
    _, a, b = max(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, -i, -j) for i, p in enumerate(points) for j, q in enumerate(points) if i < j)
    a, b = -a, -b
    return plain_line(points[a : b + 1], off)[:-1] + plain_line(points[b:] + points[: a + 1], off)[:-1]


@pytest.mark.parametrize("seed", range(12))
def test_threshold_border_and_corners(seed):
    rng = np.random.default_rng(seed)
    gray = rng.integers(0, 256, (9, 7)).astype(np.uint8) if seed % 2 else rng.choice([7, 7, 200], (9, 7)).astype(np.uint8)
    assert contours.otsu_threshold(gray) == plain_otsu(gray)
    inside = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.3, 0.5, 0.7, 0.95])
    border = contours.longest_border(inside)
    assert [tuple(p) for p in border.tolist()] == plain_border(inside)
    points = [(float(x), float(y)) for x, y in border.tolist()]
    assert [tuple(p) for p in contours.simplify(border, 1.1).tolist()] == plain_corners(points, 1.1)


def canvas(h, w, ground, paint):
    gray = np.full((h, w), ground, np.uint8)
    paint(gray)
    return gray


def test_outlines_of_rasters(spark):
    square = canvas(60, 80, 230, lambda g: g.__setitem__((slice(10, 50), slice(20, 60)), 10))
    yy, xx = np.mgrid[:120, :120]
    disc = np.where((xx - 60) ** 2 + (yy - 60) ** 2 < 40**2, 250, 3).astype(np.uint8)
    rows = [(1, square.tobytes(), 80), (2, disc.tobytes(), 120), (3, None, 4), (4, b"abc", 2), (5, bytes([9] * 16), 4), (None, square.tobytes(), 80), (6, b"", 0)]
    found = contours.outlines(spark.createDataFrame(rows, "id long, px binary, w int"), "px", "w", ["id"])
    got = {r.id: r for r in found.collect()}
    assert [(p.x, p.y) for p in got[1].points] == [(20, 10), (59, 10), (59, 49), (20, 49)] and got[1].drawn == 1600 and got[1].threshold == 10
    assert got[None].points == got[1].points and got[2].image_height == 120
    assert got[3].error == got[6].error == "no image" and "fill" in got[4].error and got[5].contour_points > 0 or got[5].error
    features = shapes.outline_features(found.filter("error is null and id <= 2").withColumn("closed", F.lit(True)).withColumn("asset_id", F.col("id")), "points", "closed")
    best = {r.asset_id: r for r in features.collect()}
    assert best[1].rectangularity == pytest.approx(1) and best[1].regularity == pytest.approx(1) and best[1].aspect == pytest.approx(1)
    assert best[2].compactness > 0.9 and best[2].solidity > 0.98 and best[2].vertices >= 8
    hit = shapes.similar_shapes(features, {**{k: best[1][k] for k in shapes.FEATURES}, "closed": True}).collect()
    assert hit[0].asset_id == 1 and hit[0].score == pytest.approx(1)


DRAWING = """0
SECTION
2
HEADER
0
ENDSEC
0
LINE
8
OUT
10
0
0
SECTION
2
ENTITIES
0
LINE
8
WALLS
10
0.0
20
0.0
11
3.0
21
4.0
0
CIRCLE
8
POOL
10
5
20
10
40
2
0
CIRCLE
10
5
20
10
40
-1
0
ARC
10
0
20
0
40
2
50
350
51
80
0
LWPOLYLINE
8
DÖŞEME
70
1
10
0
20
0
10
4
20
0
10
4
20
2
10
0
20
2
0
LWPOLYLINE
70
0
10
1
10
2
20
bad
10
3
20
1
10
9
0
POLYLINE
8
ROOF
66
1
70
1
0
VERTEX
8
other
10
0
20
0
0
VERTEX
10
6
20
0
0
VERTEX
10
x
20
0
0
VERTEX
10
0
20
3
0
SEQEND
8
z
0
TEXT
1
note
0
POLYLINE
70
0
0
LINE
10
1
20
1
11
4
21
1
0
ENDSEC
0
CIRCLE
10
0
20
0
40
9
"""


def test_shapes_of_drawings(spark, tmp_path):
    folder = tmp_path / "drawings"
    folder.mkdir()
    (folder / "plan.dxf").write_bytes(DRAWING.replace("\n", "\r\n").encode("cp1254"))
    (folder / "cut.dxf").write_bytes(b"0\nSECTION\n2\nENTITIES\n0\nLWPOLYLINE\n70\n1\n10\n0\n20\n0\n10\n1\n20\n0\n10\n1\n20\n1\n10")
    (folder / "empty.dxf").write_bytes(b"")
    rows = drawings.with_features(drawings.read_shapes(spark, f"file://{folder}")).cache()
    plan = {r.shape_id: r for r in rows.filter("path like '%plan.dxf'").collect()}
    assert [plan[i].entity_type for i in sorted(plan)] == ["LINE", "CIRCLE", "ARC", "LWPOLYLINE", "LWPOLYLINE", "POLYLINE", "LINE"]
    line, circle, arc, floor, open_, roof, flat = (plan[i] for i in range(7))
    assert (line.layer_name, line.category, line.vertices, line.is_closed) == ("WALLS", "DUVAR", 2, False)
    assert line.perimeter == pytest.approx(5) and line.aspect == pytest.approx(0.75) and (line.box_width, line.box_height, line.centroid_x, line.centroid_y) == (3, 4, 1.5, 2)
    assert circle.area == pytest.approx(math.pi * 4) and circle.perimeter == pytest.approx(4 * math.pi) and circle.rectangularity == pytest.approx(math.pi / 4)
    assert (circle.vertices, circle.box_width, circle.centroid_y, circle.category, circle.solidity) == (1, 4, 10, "HAVUZ", 1)
    assert arc.perimeter == pytest.approx(2 * math.radians(90)) and arc.area == 0 and arc.layer_name == "0" and arc.category == "DIGER" and not arc.is_closed
    assert (floor.area, floor.perimeter, floor.aspect, floor.rectangularity, floor.solidity, floor.category) == (8, 12, 2, 1, 1, "DOSEME")
    assert floor.compactness == pytest.approx(4 * math.pi * 8 / 144)
    assert [(p.x, p.y) for p in open_.points] == [(1, 0), (3, 1)] and open_.area == 0 and open_.perimeter == pytest.approx(math.hypot(2, 1))
    assert (roof.layer_name, roof.vertices, roof.area, roof.category) == ("ROOF", 3, 9, "CATI")
    assert flat.aspect == 0 and flat.perimeter == 3
    assert rows.filter("path like '%cut.dxf'").count() == 1 and rows.filter("path like '%empty.dxf'").count() == 0
    kept = shapes.searchable(rows)
    assert sorted(r.shape_id for r in kept.filter("path like '%plan.dxf'").collect()) == [1, 2, 3, 5]
    hits = shapes.similar_shapes(kept, {**{k: floor[k] for k in shapes.FEATURES}, "closed": True}, asset="path").collect()
    assert hits[0].path.endswith("plan.dxf") and hits[0].score == pytest.approx(1)


def composite_plain(rows, refs, least):
    def near(a, b):
        v = math.exp(-((a["vertices"] - b["vertices"]) ** 2) / (2 * max(0.3 * max(a["vertices"], b["vertices"]), 1.5) ** 2))
        ratio = 1 - abs(a["aspect"] - b["aspect"]) / max(a["aspect"], b["aspect"], 0.01)
        part = lambda k: max(0, 1 - abs(a[k] - b[k]))
        if a["closed"] and b["closed"]:
            return 0.2 * v + 0.2 * part("compactness") + 0.15 * part("regularity") + 0.15 * ratio + 0.15 * part("rectangularity") + 0.1 * part("solidity") + 0.05
        if not a["closed"] and not b["closed"]:
            return 0.35 * ratio + 0.3 * v + 0.25 * part("regularity") + 0.1
        return 0.3 * v + 0.2 * ratio

    by = {}
    for r in rows:
        by.setdefault(r["asset_id"], []).append(r)
    out = []
    for a in refs:
        hits = []
        for b in by:
            if b != a and a in by:
                m = sum(any(near(x, y) >= 0.9 for y in by[b]) for x in by[a]) + sum(any(near(x, y) >= 0.9 for x in by[a]) for y in by[b])
                score = math.floor(m * 100 / (len(by[a]) + len(by[b])) + 0.5)
                if score >= max(1, least):
                    hits.append((-score, b))
        out += [(a, b, -s / 100, k) for k, (s, b) in enumerate(sorted(hits), 1)]
    return sorted(out)


def test_composite_search(spark):
    rng = np.random.default_rng(3)
    rows = [{"asset_id": int(rng.integers(0, 12)), "shape_id": i, "vertices": float(rng.integers(3, 7)), "closed": bool(rng.random() < 0.7), **{k: float(rng.choice([0.2, 0.9, 1.0])) for k in ("compactness", "regularity", "aspect", "rectangularity", "solidity")}} for i in range(120)]
    df = spark.createDataFrame(rows, "asset_id long, shape_id long, vertices double, closed boolean, compactness double, regularity double, aspect double, rectangularity double, solidity double")
    refs = spark.createDataFrame([(0,), (3,), (7,), (99,)], "asset_id long")
    got = sorted(map(tuple, shapes.composite_search(df, refs, 5, 200).collect()))
    assert got == composite_plain(rows, [0, 3, 7, 99], 5) and got


def entry(order, tag, kind, count, field):
    return struct.pack(order + "HHI", tag, kind, count) + field.ljust(4, b"\0")[:4]


def exif(order, south=True, far=0):
    """A block of linked directories: make, program, camera part and place; far moves the values away."""
    body, at = {}, 200 + far

    def kept(raw):
        nonlocal at
        body[at] = raw
        at += len(raw) + len(raw) % 2
        return struct.pack(order + "I", at - len(raw) - len(raw) % 2)

    text = lambda s: (2, len(s) + 1, kept(s.encode() + b"\0"))
    ratio = lambda *p: (5, len(p) // 2, kept(struct.pack(f"{order}{len(p)}I", *p)))
    first = [(0x010F, *text("Canon Inc")), (0x0131, *text("V-Ray Next 4")), (0x8769, 4, 1, struct.pack(order + "I", 60)), (0x8825, 4, 1, struct.pack(order + "I", 140)), (0x9999, 77, 5, b"")]
    camera = [(0x829A, *ratio(1, 60)), (0x8827, 3, 1, struct.pack(order + "H", 400)), (0x9003, *text("2020:01:02 03:04:05")), (0x920A, *ratio(350, 10)), (0xA001, 3, 1, struct.pack(order + "H", 1)), (0x9004, 2, 4000, struct.pack(order + "I", 1 << 30))]
    place = [(1, 2, 2, b"S\0" if south else b"N\0"), (2, *ratio(36, 1, 30, 1, 0, 1)), (3, 2, 2, b"E\0"), (4, *ratio(*((28, 1, 0, 1, 36, 1) if south else (28, 0, 0, 1, 0, 1))))]
    out = bytearray(at)
    out[:8] = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    # 8: 5 entries (62 bytes) overlap 60, so the first directory goes to the end
    start = len(out)
    out[4:8] = struct.pack(order + "I", start)
    out += struct.pack(order + "H", len(first)) + b"".join(entry(order, *e) for e in first)
    for place_at, entries in ((60, camera), (140, place)):
        raw = struct.pack(order + "H", len(entries)) + b"".join(entry(order, *e) for e in entries)
        out[place_at : place_at + len(raw)] = raw
    for where, raw in body.items():
        out[where : where + len(raw)] = raw
    return bytes(out)


def png(gray, extra=b"", colour=0, filters=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = gray.shape[:2]
    step = gray.shape[2] if gray.ndim == 3 else 1
    rows, above = b"", np.zeros(w * step, int)
    for y, row in enumerate(gray.reshape(h, -1).astype(int)):
        kind = filters[y % len(filters)] if filters else 0
        left, corner = np.concatenate((np.zeros(step, int), row[:-step])), np.concatenate((np.zeros(step, int), above[:-step]))
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        near = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = [0 * row, left, above, (left + above) // 2, near][kind]
        rows += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("order", ["<", ">"])
def test_camera_fields(order):
    block = exif(order)
    found = images.camera_fields(images.of_bytes(block))
    assert found == {"camera_make": "Canon Inc", "software": "V-Ray Next 4", "date_taken": "2020-01-02 03:04:05", "color_space": "sRGB", "focal_length": "35", "exposure_time": "1/60", "iso_speed": "400", "gps_lat": -36.5, "gps_lon": 28.01, "is_render": True}
    jpeg = b"\xff\xd8\xff\xe0\0\4ab" + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"
    webp = b"RIFF\0\0\0\0WEBPVP8 \3\0\0\0abc\0EXIF" + struct.pack("<I", len(block)) + block
    inner = png(np.zeros((2, 2), np.uint8), struct.pack(">I", len(block)) + b"eXIf" + block + b"\0\0\0\0")
    assert found == images.camera_fields(images.of_bytes(jpeg)) == images.camera_fields(images.of_bytes(webp)) == images.camera_fields(images.of_bytes(inner))
    other = images.camera_fields(images.of_bytes(exif(order, south=False)))
    assert other["gps_lat"] == 36.5 and "gps_lon" not in other  # a denominator of 0
    for cut in range(0, len(block), 7):  # broken offsets and ends give less, never an error
        assert set(images.camera_fields(images.of_bytes(block[:cut]))) <= set(found)
    assert images.camera_fields(images.of_bytes(b"")) == {} == images.camera_fields(images.of_bytes(b"II*\0\xff\xff\xff\xff"))


@pytest.mark.parametrize("channels", [1, 3])
def test_decoders(channels):
    rng = np.random.default_rng(channels)
    pixels = rng.integers(0, 256, (11, 6, channels)).astype(np.uint8)
    for filters in ([0], [1], [2], [3], [4], [0, 1, 2, 3, 4]):
        assert (images.decode_image(png(pixels, colour=0 if channels == 1 else 2, filters=filters)) == pixels).all()
    pnm = (b"P5" if channels == 1 else b"P6") + b"\n# note\n6 11\n255\n" + pixels.tobytes()
    assert (images.decode_image(pnm) == pixels).all()
    if channels == 3:
        rows = b"".join(r[:, ::-1].tobytes().ljust(20, b"\0") for r in pixels[::-1])
        bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 11, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
        assert (images.decode_image(bmp) == pixels).all()
    for bad in (b"", b"GIF89a", png(pixels)[:40]):
        with pytest.raises(Exception):
            images.decode_image(bad)


def test_image_files_to_kinds_and_places(spark, tmp_path):
    folder = tmp_path / "pictures"
    folder.mkdir()
    block = exif(">", far=70_000)  # values beyond the first bytes that are read
    (folder / "a.tif").write_bytes(block)
    square = canvas(60, 80, 230, lambda g: g.__setitem__((slice(10, 50), slice(20, 60)), 10))
    (folder / "b.png").write_bytes(png(square))
    (folder / "b.max").write_bytes(b"x")
    (folder / "c.jpg").write_bytes(b"\xff\xd8 broken")
    (folder / "plain.png").write_bytes(png(np.zeros((512, 1024), np.uint8)))
    headers = images.read_headers(spark, f"file://{folder}").cache()
    by = {r.file_name: r for r in headers.collect()}
    assert set(by) == {"a.tif", "b.png", "c.jpg", "plain.png"} and not any(r.error for r in by.values())
    assert by["a.tif"].gps_lat == -36.5 and by["a.tif"].camera_make == "Canon Inc" and (by["b.png"].width, by["b.png"].height) == (80, 60)
    metadata = images.metadata_rows(headers)
    places = geo.geo_assets(metadata).collect()
    assert [(p.lat, p.lon) for p in places] == [(-36.5, 28.01)] and places[0].asset_id.endswith("a.tif")
    files = spark.createDataFrame([(n, str(folder)) for n in ("a.tif", "b.png", "b.max", "c.jpg", "plain.png")], "file_name string, folder string")
    joined = classify.sibling_extensions(files, folder="folder").join(headers.drop("path", "ext"), "file_name")
    camera = F.coalesce("camera_make", "camera_model", "focal_length", "exposure_time", "iso_speed", F.col("gps_lat").cast("string")).isNotNull()
    kind = classify.image_kind(F.col("file_name"), F.lit("x/y"), camera, F.col("is_render"), F.col("width"), F.col("height"), F.col("software"), F.col("siblings"))
    assert {r.file_name: r.kind for r in joined.select("file_name", kind.alias("kind")).collect()} == {"a.tif": "Fotoğraf", "b.png": "Render", "c.jpg": None, "plain.png": "Doku"}
    seen = {r.path.rsplit("/", 1)[1]: r for r in images.read_visuals(spark, f"file://{folder}").collect()}
    assert [(p.x, p.y) for p in seen["b.png"].points] == [(20, 10), (59, 10), (59, 49), (20, 49)] and seen["b.png"].phash is not None
    assert seen["b.png"].dominant_colors[0].r == 230 and seen["c.jpg"].error and seen["plain.png"].error is None


def test_image_kind_rules(spark):
    rows = [("plain.jpg", "x", False, "Blender 4", 100, 100, []), ("plain.jpg", "x", False, None, 512, 2048, []), ("plain.jpg", "x", False, None, 3000, 1500, []), ("oak texture.jpg", "x", False, None, 3000, 1500, ["max"]), ("foto 1.jpg", "x", False, "vray", 512, 512, ["psd"]), ("plain.jpg", "x", False, None, 300, 300, ["PSD"]), ("scene.jpg", "x", True, "vray", 10, 10, []), ("plain.jpg", "x", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, folder string, camera boolean, software string, w int, h int, sib array<string>")
    kind = classify.image_kind(F.col("name"), F.col("folder"), F.col("camera"), None, F.col("w"), F.col("h"), F.col("software"), F.col("sib"))
    assert [r[0] for r in df.select(kind).collect()] == ["Render", "Doku", "Render", "Doku", "Fotoğraf", "Render", "Fotoğraf", None]
