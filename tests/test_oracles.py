"""Every registered core query against its SQL on the smallest tables."""

import glob
import html
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from strataq.plans import service_queries  # noqa: F401
from strataq.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x is pd.NaT or (isinstance(x, (float, np.floating)) and np.isnan(x)) else round(float(x), 5) if isinstance(x, (float, np.floating)) else str(x)
    return sorted(str([plain(x) for x in row]) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    own, sql = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    assert rows(own) == rows(sql)


# Queries without SQL: each against a plain version over the same whole tables.


@pytest.fixture(scope="module")
def hashes(spark):
    from strataq.plans.queries import _hashes

    return {r.doc_id: r.h for r in _hashes(spark, FOLDER).collect()}


def linked(nodes, edges):
    """The smallest node of each node's component."""
    least = {n: n for n in nodes}
    while True:
        moved = False
        for a, b in edges:
            low = min(least[a], least[b])
            moved |= low < max(least[a], least[b])
            least[a] = least[b] = low
        if not moved:
            return least


def near(values, distance=3):
    values = sorted(set(values))
    return {(a, b): (a ^ b).bit_count() for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= distance}


def test_hamming_pairs(spark, hashes):
    assert {(r.a, r.b): r.d for r in QUERIES["hamming_pairs"](spark, FOLDER).collect()} == near(hashes.values())


def test_visual_groups_and_components(spark, hashes):
    edges = near(hashes.values())
    component = linked(set(hashes.values()), edges)
    members = {}
    for i, h in hashes.items():
        members.setdefault(component[h], []).append(i)
    worst = {}
    for (a, _), d in edges.items():
        worst[component[a]] = max(worst.get(component[a], 0), d)
    want = {i: (min(own), 100 - (worst.get(c, 0) * 100 + 32) // 64) for c, own in members.items() if len(own) > 1 for i in own}
    got = {r.id: (r.component, r.score) for r in QUERIES["visual_groups"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(s >= want[i][1] for i, (_, s) in got.items())  # the links that join a group, not all of its pairs, set its score
    assert {r.id: r.component for r in QUERIES["dup_components"](spark, FOLDER).collect()} == {i: c for i, (c, _) in want.items()}


def test_version_closure(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()
    customer = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect()}
    edges = {(2 * customer[r.l_orderkey], 2 * r.l_suppkey + 1) for r in lines if r.l_orderkey in customer}
    want = linked({n for e in edges for n in e}, edges)
    assert {r.node: r.component for r in QUERIES["version_closure"](spark, FOLDER).collect()} == want


def test_page_text(spark):
    got = {r.page_id: (r.title, r.text) for r in QUERIES["page_text"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", r.html)
        plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"(?s)<[^>]*>", " ", bare)).strip(" ")
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", r.html)
        assert got.pop(r.page_id) == (title[1] if title and title[1] else None, html.unescape(plain))
    assert not got


def test_image_outlines(spark):
    from strataq.functions import contours
    from strataq.plans.queries import _rasters

    got = {r.vec_id: r for r in QUERIES["image_outlines"](spark, FOLDER).collect()}
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    rasters = {r.vec_id: r.pixels for r in _rasters(spark, FOLDER).collect()}
    for i, vector in vectors.items():
        cells = np.clip(np.floor(128 + 400 * np.asarray(vector, np.float64)), 0, 255).astype(np.uint8).reshape(8, 8)
        gray = np.kron(cells, np.ones((4, 4), np.uint8))
        assert rasters[i] == gray.ravel().tolist()
        corners, n = contours.outline(gray)  # held against plain loops in test_images_drawings
        x, y = corners.T
        area = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
        length = float(np.hypot(np.roll(x, -1) - x, np.roll(y, -1) - y).sum())
        row = got.pop(i)
        assert (row.contour_points, row.vertices) == (n, len(corners)) and abs(row.area - area) < 1e-6 and abs(row.perimeter - length) < 1e-6
        edges = np.hypot(np.roll(x, -1) - x, np.roll(y, -1) - y)
        back, on = np.stack((np.roll(x, 1) - x, np.roll(y, 1) - y)), np.stack((np.roll(x, -1) - x, np.roll(y, -1) - y))
        turns = np.abs(np.arctan2(back[0] * on[1] - back[1] * on[0], (back * on).sum(0)))
        assert abs(row.regularity - np.exp(-2 * (edges.std() / edges.mean() + turns.std() / turns.mean()))) < 1e-6
    assert not got


def test_knn_cells_recall(spark):
    folder = "/root/testdata/sf0.1"  # the smallest tables have too few vectors for cells
    exact = {(r.query_id, r.id) for r in QUERIES["knn_cosine"](spark, folder).collect()}
    found = {(r.query_id, r.id) for r in QUERIES["knn_cells"](spark, folder).collect()}
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.98


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLES) == {"hamming_pairs", "visual_groups", "dup_components", "version_closure", "page_text", "image_outlines", "knn_cells"}
