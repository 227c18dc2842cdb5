"""Legacy import, checks of files, and images as a model takes them."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.functions import images
from strataq.operators import legacy
from strataq.sources import checks

TYPES = ["Kat Planı", "Cephe", "Kesit", "Detay", "Diğer"]
FULL = '{"dwgDrawingType":"Kat Planı","dwgDescription":" 3. kat ","dwgElements":["duvar",7,"","kapı"],"dwgSpaces":["salon"],"dwgKeywords":["konut"],"dwgDomainTerms":["mukarnas"]}'


@pytest.fixture(scope="module")
def mapped(spark):
    rows = [
        (1, FULL, None, "2026-06-27T10:00:00Z"),
        (2, '{"dwgDrawingType":"1. kat plani","dwgDescription":"taslak"}', None, None),
        (3, '{"dwgDrawingType":"Uydurma Tur","dwgDescription":"x"}', None, None),
        (4, '{"dwgDescription":"cami","dwgKeywords":["Minare","kubbe"]}', '[{"label":"minare"},{"label":"cami"},{"x":1},3]', "bad"),
        (5, '{"aiClassification":{"type":"Render","confidence":0.8}}', None, None),
        (6, '{"aiClassification":{"type":"Kolaj"}}', None, None),
        (7, "bozuk{", None, None),
        (8, "{}", "[]", None),
        (9, None, None, None),
        (10, '{"dwgDescription":5,"dwgElements":"no list","dwgSpaces":{"a":1}}', '{"label":"x"}', None),
        (11, '{"dwgDescription":"a","dwgSpaces":["b"]}', "not json", None),
    ]
    df = spark.createDataFrame(rows, "legacy_id long, metadata_json string, ai_tags_json string, extracted_at string")
    return legacy.map_fields(df, "metadata_json", "ai_tags_json", "extracted_at", TYPES)


def test_map_fields(mapped):
    got = {r.legacy_id: r.ai for r in mapped.collect()}
    fields = {i: dict((p.key, p.value) for p in ai.fields) for i, ai in got.items() if ai}
    assert fields[1] == {"ai_cizim_turu": "Kat Planı", "ai_aciklama": "3. kat", "ai_elemanlar": "duvar, kapı", "ai_mekanlar": "salon", "ai_ozel_terimler": "mukarnas", "ai_anahtar_kelimeler": "konut", "ai_model": "h2-import", "ai_analyzed_at": "1782554400000"}
    assert fields[2]["ai_cizim_turu"] == "Kat Planı" and not got[2].type_dropped
    assert got[3].type_dropped and got[3].too_thin and not fields[3]
    assert fields[4] == {"ai_aciklama": "cami", "ai_anahtar_kelimeler": "Minare, kubbe, cami", "ai_model": "h2-import"}
    assert got[5].image_kind == "Render" and not fields[5] and not got[5].too_thin
    assert got[6] is None and got[8] is None and got[9] is None and got[10] is None
    assert got[7].bad_json and not fields[7] and got[11].bad_json and fields[11]["ai_mekanlar"] == "b"


def test_import_by_one_plan(spark, mapped):
    catalog = spark.createDataFrame([(10, "C:/a/One.dwg"), (12, "c:/b.dwg")], "id long, path string")
    metadata = spark.createDataFrame([(10, "ai_model", "own")], "asset_id long, key string, value_text string")
    paths = {1: "c:/a/one.dwg", 2: "c:/new.dwg", 3: "c:/NEW.dwg", 4: None, 5: "c:/pic.jpg", 6: " ", 7: "c:/gone.dwg", 8: "c:/x", 9: "c:/y", 10: "c:/z", 11: "c:/w"}
    rows = spark.createDataFrame([(i, p, i == 7) for i, p in paths.items()], "legacy_id long, path string, deleted boolean").join(mapped, "legacy_id")
    plan = legacy.plan_import(catalog, rows)
    got = {r.legacy_id: (r.action, r.reason, r.id) for r in plan.collect()}
    assert got[1] == ("match", None, 10) and got[2] == ("add", None, 13) and got[3] == ("skip", "repeated path", None)
    assert got[4] == got[6] == ("skip", "no path", None) and got[7] == ("skip", "deleted", None)
    assert [got[i][2] for i in (5, 8, 9, 10, 11)] == [14, 15, 16, 17, 18]
    dry = legacy.import_report(plan).first()
    assert (dry.seen, dry.added, dry.matched, dry.skipped, dry.analysed) == (11, 6, 1, 4, 3)
    assert [(p.legacy_id, p.problem) for p in dry.problems] == [(3, "repeated path"), (4, "no path"), (6, "no path"), (7, "bad json"), (11, "bad json")]
    new_catalog, new_metadata = legacy.apply_import(catalog, metadata, plan)
    assert new_catalog.count() == 8 and legacy.import_report(plan).first() == dry
    values = {(r.asset_id, r.key): r.value_text for r in new_metadata.collect()}
    assert values[10, "ai_model"] == "own" and values[10, "ai_mekanlar"] == "salon" and values[14, "ai_gorsel_turu"] == "Render" and values[13, "ai_model"] == "h2-import"
    again = legacy.plan_import(new_catalog, rows)
    assert legacy.import_report(again).first().added == 0
    assert legacy.import_report(legacy.plan_import(catalog, rows.limit(0))).first().seen == 0


def test_fixity_and_formats(spark, tmp_path):
    made = {"a.docx": b"PK\x03\x04abcdef", "b.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "c.doc": b"PK\x03\x04", "d.xlsx": bytes.fromhex("D0CF11E0A1B11AE1"), "e.ppt": b"hello", "f.txt": b"text", "h.xls": b""}
    rows = []
    for i, (name, content) in enumerate(sorted(made.items())):
        (tmp_path / name).write_bytes(content)
        digest = hashlib.sha256(content).hexdigest()
        rows.append((i, f"file://{tmp_path}/{name}", name.rsplit(".", 1)[1], digest if name != "c.doc" else "0" * 64))
    rows += [(90, f"file://{tmp_path}/gone.doc", "doc", "1"), (91, f"file://{tmp_path}/f.txt", "txt", None), (92, None, "doc", "2")]
    assets = spark.createDataFrame(rows, "id long, path string, ext string, content_hash string")
    states = checks.fixity(assets)
    got = {r.id: r.state for r in states.collect()}
    assert got == {0: "ok", 1: "ok", 2: "mismatch", 3: "ok", 4: "ok", 5: "ok", 6: "ok", 90: "missing", 92: "missing"}
    counts, listed = checks.check_report(states)
    assert {r.state: r.n for r in counts.collect()} == {"ok": 6, "mismatch": 1, "missing": 2} and listed.count() == 3
    assert checks.fixity(assets, 50).count() == 5 and checks.fixity(assets.limit(0)).count() == 0
    kinds = {r.path.rsplit("/", 1)[1]: r.state for r in checks.office_formats(assets).collect()}
    assert kinds == {"a.docx": "ok", "b.doc": "legacy_binary", "c.doc": "extension_mismatch", "d.xlsx": "extension_mismatch", "e.ppt": "unknown", "h.xls": "unknown"}


def plain_line(line, wanted):
    """One line of samples by the cubic kernel, a sample after the other."""
    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x * x + 1 if x < 1 else -0.5 * x**3 + 2.5 * x * x - 4 * x + 2 if x < 2 else 0.0

    ratio = len(line) / wanted
    wide = max(ratio, 1.0)
    out = []
    for i in range(wanted):
        centre = (i + 0.5) * ratio
        low = min(max(math.floor(centre - 2 * wide), 0), len(line) - 1)
        high = min(max(math.ceil(centre + 2 * wide), low + 1), len(line))
        weights = [kernel((k - (centre - 0.5)) / wide) for k in range(low, high)]
        out.append(sum(w * v for w, v in zip(weights, line[low:high])) / sum(weights))
    return out


@pytest.mark.parametrize("shape", [(9, 14, 3), (14, 9, 1), (5, 5, 3), (30, 8, 3)])
def test_model_input(shape):
    rng = np.random.default_rng(sum(shape))
    pixels = rng.integers(0, 256, shape).astype(np.uint8)
    side = 8
    got = images.model_input(pixels, side=side)
    h, w = shape[:2]
    wide, high = (side, math.floor(h * side / w + 0.5)) if w < h else (math.floor(w * side / h + 0.5), side)
    wide, high = max(wide, side), max(high, side)
    assert got.shape == (3, side, side) and got.dtype == np.float32
    for c in range(3):
        plane = pixels[:, :, min(c, shape[2] - 1)].astype(float).tolist()
        down = list(zip(*[plain_line(list(col), high) for col in zip(*plane)]))
        scaled = [plain_line(list(row), wide) for row in down]
        x, y = (wide - side) // 2, (high - side) // 2
        want = [[(math.floor(min(max(scaled[y + j][x + i], 0), 255) + 0.5) / 255 - images.MEAN[c]) / images.DEVIATION[c] for i in range(side)] for j in range(side)]
        assert np.abs(got[c] - np.array(want)).max() < 0.02 and np.mean(np.abs(got[c] - np.array(want)) > 1e-4) < 0.02
    region = images.model_input(pixels, (1, 1, 4), side=side)
    assert np.array_equal(region, images.model_input(pixels[1:5, 1:5], (0, 0, 4), side=side))
    assert images.model_input(pixels, (0, 0, 99), side=side).shape == (3, side, side)
    for bad in ((99, 0, 4), (0, 0, 0), (-1, 0, 3)):
        with pytest.raises(ValueError):
            images.model_input(pixels, bad, side=side)
