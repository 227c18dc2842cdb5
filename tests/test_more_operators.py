import io
import struct

import numpy as np
from pyspark.sql import functions as F

from strataq.functions import images
from strataq.operators import archive, classify, geo, shapes


def test_outline_features_and_search(spark):
    square, bar = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (8.0, 0.0), (8.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(1, square, True, "LWPOLYLINE"), (2, bar, True, "LWPOLYLINE"), (3, square[:3], False, "LWPOLYLINE"), (4, square[:2], False, "LINE")], "asset_id long, p array<struct<x:double,y:double>>, closed boolean, entity_type string")
    rows = shapes.searchable(shapes.outline_features(df, "p", "closed"))
    got = {r.asset_id: r for r in rows.collect()}
    assert sorted(got) == [1, 2, 3] and got[1].regularity == 1.0 and got[1].rectangularity == 1.0 and got[2].aspect == 8.0 and got[3].area == 0.0
    assert got[1].solidity == got[2].solidity == 1.0 and got[3].solidity == 0.0 and 0 < got[2].regularity < 0.3
    corner = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)], True)], "p array<struct<x:double,y:double>>, closed boolean")
    assert abs(shapes.outline_features(corner, "p", "closed").first().solidity - 3 / 3.5) < 1e-9
    goal = {k: got[1][k] for k in [*shapes.FEATURES, "closed"]}
    best = shapes.similar_shapes(rows, goal).collect()
    assert best[0].asset_id == 1 and abs(best[0].score - 1.0) < 1e-9 and best[0].score > best[1].score
    assert shapes.filter_shapes(rows.withColumn("category", F.lit("x")), shapes.ShapeCriteria(vertices=4, min_regularity=0.9)).count() == 1


def test_structural_groups(spark):
    base = {"compactness": 0.8, "regularity": 0.9, "rectangularity": 0.7, "solidity": 0.95, "closed": True}
    rows = [(a, i, *(float(v), 0.8, 0.9, asp, 0.7, 0.95, True)) for a, kinds in ((1, (4, 9, 30)), (2, (4, 9, 30)), (3, (60, 200)), (4, (4,))) for i, (v, asp) in enumerate((k, 1.0 + k / 10) for k in kinds)]
    df = spark.createDataFrame(rows, "asset_id long, shape_id long, vertices double, compactness double, regularity double, aspect double, rectangularity double, solidity double, closed boolean")
    assert base["closed"]
    pairs = {(r.a, r.b): r.score for r in shapes.overlap_scores(df).collect()}
    assert pairs[1, 2] == 100 and pairs[1, 4] == 50 and (1, 3) not in pairs
    assert {(r.id, r.component, r.score) for r in shapes.structural_groups(df, 60).collect()} == {(1, 1, 100), (2, 1, 100)}


def test_layers_and_kinds(spark):
    df = spark.createDataFrame([("A-DUVAR", "IMG_1234.jpg", "x"), ("foo", "salon_vray.png", "foto"), (None, "a.png", "Santiye Foto"), (None, "salon_vray.png", "x"), (None, "DSC_0001_diff.jpg", "x"), (None, "brick.png", "p/textures"), (None, "sony.png", "p/renders"), (None, "last view 2.png", "x"), (None, "overview.png", "x")], "layer string, name string, folder string")
    rows = df.select(shapes.layer_category(F.col("layer")).alias("l"), classify.image_kind(F.col("name"), F.col("folder")).alias("k")).collect()
    assert [tuple(r) for r in rows] == [("DUVAR", "Fotoğraf"), ("DIGER", "Fotoğraf"), (None, "Fotoğraf"), (None, "Render"), (None, "Doku"), (None, "Doku"), (None, "Fotoğraf"), (None, "Render"), (None, None)]


def test_labelled_text(spark):
    text = "TUR: Render\nETIKETLER: salon, mutfak; salon\nYOK\nRENK: mavi"
    row = spark.createDataFrame([(text, "2, 9, 1")], "t string, o string").select(
        classify.labelled_section(F.col("t"), "TUR", ["TUR", "ETIKETLER", "RENK"]), classify.listed(classify.labelled_section(F.col("t"), "ETIKETLER", ["TUR", "ETIKETLER", "RENK"])),
        classify.rerank_order(F.col("o"), 3), classify.translate_words(F.lit("Ev kapısı ve ev"), {"ev": "house", "ev kapısı": "house door"}), classify.mime_type(F.lit("png")), classify.organise_path([F.lit("a"), F.lit(None), F.lit("b")]),
    ).first()
    assert list(row) == ["Render", ["salon", "mutfak"], [2, 1, 3], "house door ve house", "image/png", "a/b"]


def test_nearest_place_equals_full_search(spark):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-85, 85, 60), rng.uniform(-179, 179, 60)))], "id long, lat double, lon double")
    places = spark.createDataFrame([(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-85, 85, 300), rng.uniform(-179, 179, 300)))], "place string, lat double, lon double")
    p = {r.place: (r.lat, r.lon) for r in places.collect()}
    want = {r.id: min(p, key=lambda n: ((r.lon - p[n][1]) * np.cos(np.radians((r.lat + p[n][0]) / 2))) ** 2 + (r.lat - p[n][0]) ** 2) for r in points.collect()}
    assert {r.id: r.place for r in geo.nearest_place(points, places, "id").collect()} == want


def test_geo_assets(spark):
    meta = spark.createDataFrame([(1, "latitude", 40.0), (1, "longitude", 29.0), (2, "latitude", 95.0), (2, "longitude", 1.0), (3, "latitude", 1.0)], "asset_id long, key string, value_num double")
    assert [tuple(r) for r in geo.geo_assets(meta).collect()] == [(1, 40.0, 29.0)]


def test_image_kernels(spark):
    rng = np.random.default_rng(1)
    gray = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16))).astype(np.uint8)
    noisy = np.clip(gray.astype(int) + rng.integers(-3, 4, gray.shape), 0, 255).astype(np.uint8)
    a, b = images.perceptual_hash(gray), images.perceptual_hash(noisy)
    assert (a ^ b).bit_count() <= 3 and 0 <= a < 1 << 63
    rgb = np.array([[[250, 0, 0]] * 3 + [[0, 0, 250]]] * 4, np.uint8)
    found = images.dominant_colors(rgb)
    assert (found[0]["r"], found[0]["b"], round(found[0]["percentage"])) == (250, 0, 75)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9)
    jpg = b"\xff\xd8" + struct.pack(">BBHBHH", 0xFF, 0xC0, 17, 8, 5, 6) + b"\0" * 20
    assert images.image_size(png) == (7, 9) and images.image_size(jpg) == (6, 5) and images.image_size(io.BytesIO(b"xx").read()) is None
    df = spark.createDataFrame([(bytearray(png),), (None,)], "c binary").select(images.size_column(F.col("c")).alias("s"))
    assert [(r.s.width if r.s else None) for r in df.collect()][0] == 7
    assert len(images.convex_hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]]))) == 4


def test_projects_and_staleness(spark):
    assets = spark.createDataFrame([(1, "/r/Ev/a.dwg", None), (2, "/r/b.dwg", None), (3, "/r/Ofis/c.dwg", 9), (4, "/r/Yeni/d.dwg", None)], "id long, path string, project_id long")
    projects = spark.createDataFrame([(9, "Ev")], "id long, name string")
    out, dim = archive.auto_projects(assets, projects, "/r")
    assert {r.id: r.project_id for r in out.collect()} == {1: 9, 2: None, 3: 9, 4: 10} and dim.count() == 2
    catalog = spark.createDataFrame([("/a", 10), ("/b", 10), ("/c", 10)], "path string, modified_at long")
    listing = spark.createDataFrame([("/a", 11), ("/b", 20)], "path string, modified_at long")
    assert {r.path: r.state for r in archive.staleness(catalog, listing).collect()} == {"/a": "fresh", "/b": "stale", "/c": "missing"}
    assert archive.missing_paths(catalog, listing, "/").count() == 1 and archive.missing_paths(catalog, listing.limit(0), "/").count() == 0
