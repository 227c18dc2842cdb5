import math

import pytest
from pyspark.sql import functions as F

from strataq.functions import color, geometry, text, vectors
from strataq.operators import aggregates, archive, chunking, duplicates, filters, fulltext, graph, numbering, retrieval, similarity, tables
from strataq.operators.filters import Catalog, ListOptions
from strataq.plans.shared import materialize

DOCS = [(1, "villa plan", "villa bahce"), (2, "ofis plan", "kat"), (3, "villa kesit", "salon villa"), (4, "roof and beam", "x"), (5, "bos", "villa bahçe bulutlu roof beam")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, title string, body string")


@pytest.mark.parametrize(
    "query, ids",
    [
        ("villa", [1, 3, 5]), ("", [1, 2, 3, 4, 5]), ("villa OR ofis", [1, 2, 3, 5]), ("villa NOT salon", [1, 5]), ("villa AND salon", [3]), ('"villa bahce"', [1]), ("villa OR OR ofis", []), ("OR villa", []), ("villa AND", []), ("and", [4]),
        ("(villa", [1, 3, 5]), ("c++ :", []), ("roof and beam", [4, 5]), ('"and"', [4]), ("bulut", [5]), ("bul", []), ("kat", [2]), ("ka", []), ("villa plan", [1]), ("(ofis OR salon) plan", [2]),
    ],
)
def test_search(docs, query, ids):
    assert sorted(r.id for r in fulltext.search(docs, query, ["title", "body"]).collect()) == ids


def test_synonyms_only_without_hits(docs):
    assert [r.id for r in fulltext.search(docs, "kubbe", ["title", "body"], {"kubbe": ["salon"]}).collect()] == [3]
    assert fulltext.search(docs, "villa helikopter", ["title", "body"], {}).count() == 0


def test_snippet_marks_best_window(spark):
    row = spark.createDataFrame([("a b c d e f villa g villa h i j k l m n o p q r s t u v w x y z",)], "t string").select(fulltext.snippet(F.col("t"), ["villa"], 5)).first()[0]
    assert row.count("[villa]") == 2 and row.startswith("…") and row.endswith("…")


def test_fuzzy(spark):
    df = spark.createDataFrame([("merdiven detay",), ("merdivan",), ("kat",), (None,)], "t string")
    assert df.filter(text.fuzzy_match(F.col("t"), "merdiven")).count() == 2
    assert df.filter(text.fuzzy_match(F.col("t"), "kut")).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("\\\\?\\C:\\Proje\\\\A\\",)], "p string")
    row = df.select(
        text.normalize_path(F.col("p")), text.turkish_lower(F.lit("IİŞ")), text.normalize_tr(F.lit("ÇIĞ İş")), text.parent_dir(F.lit("/a/b.txt")), text.parent_dir(F.lit("/b")), text.parent_dir(F.lit("b")),
        text.parse_time(F.lit("2020-01-01T00:00:00Z")), text.parse_time(F.lit("1577836800")), text.parse_time(F.lit("1577836800000")), text.parse_time(F.lit("soon")), text.percent(F.lit(1), F.lit(8)), text.percent(F.lit(1), F.lit(0)),
        text.sanitize_folder(F.lit(" a<b>:c. ")), text.stem(F.lit("a.b.dwg")), text.extension(F.lit("A.DWG")), text.filetime_seconds(F.lit(116444736000000000)), text.query_component(F.lit("a b")),
    ).first()
    assert list(row) == ["//c:/proje/a", "ıiş", "cig is", "/a", "/", None, 1577836800, 1577836800, 1577836800, None, 13, 0, "a b c", "a.b", "dwg", 0, "a%20b"]


def test_color(spark):
    # A published pair of the CIEDE2000 test data.
    one, two = [F.lit(50.0), F.lit(2.6772), F.lit(-79.7751)], [F.lit(50.0), F.lit(0.0), F.lit(-82.7485)]
    row = spark.range(1).select(color.delta_e2000(one, two), color.rgb_hex(F.lit(255), F.lit(0), F.lit(16)), *color.lab(F.lit(255), F.lit(255), F.lit(255)), *color.rgb_hsl(F.lit(255), F.lit(0), F.lit(0))).first()
    assert math.isclose(row[0], 2.0425, abs_tol=1e-4) and row[1] == "#ff0010"
    assert math.isclose(row[2], 100, abs_tol=1e-2) and abs(row[3]) < 0.05 and list(row[5:8]) == [0.0, 1.0, 0.5]


def test_geometry(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    p = F.col("p")
    row = df.select(geometry.area(p), geometry.perimeter(p), geometry.perimeter(p, False), *geometry.centroid(p), geometry.rectangularity(p)).first()
    assert list(row) == [2.0, 6.0, 5.0, 1.0, 0.5, 1.0]
    shape = {k: F.lit(1.0) for k in ("vertices", "compactness", "regularity", "aspect", "rectangularity", "solidity")} | {"closed": F.lit(True)}
    assert math.isclose(spark.range(1).select(geometry.shape_similarity(shape, shape)).first()[0], 1.0)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [(r[0], r[1]) for r in df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("b"))).collect()] == [(0.0, 1.0), (1.0, 0.0)]


def test_filters(spark):
    assets = spark.createDataFrame([(1, "/a/x.pdf", "pdf", 10, None, "2024-05", 5), (2, "/A/y.dwg", "dwg", 20, None, "2025", 6), (3, "/b_/z.pdf", "pdf", 30, 1, None, 7), (4, "/b_/w.pdf", "pdf", 40, None, None, 8)], "id long, path string, ext string, size_bytes long, deleted_at long, deadline string, modified_at long")
    meta = spark.createDataFrame([(1, "k", "a"), (1, "m", "b"), (2, "k", "a")], "asset_id long, key string, value_text string")
    catalog = Catalog(assets, metadata=meta, favourites=spark.createDataFrame([(4,)], "asset_id long"), tags=spark.createDataFrame([(1, "t"), (1, "u")], "asset_id long, name string"))
    ids = lambda **o: sorted(r.id for r in filters.apply_filters(catalog, ListOptions(**o)).collect())
    assert ids() == [1, 2, 4] and ids(ext=["pdf"]) == [1, 4] and ids(path_prefix="/a/") == [1, 2] and ids(path_prefix="/b_") == [4]
    assert ids(metadata={"k": ["a"], "m": ["b", "c"]}) == [1] and ids(metadata={"k": ["a"], "m": []}) == [1, 2]
    assert ids(favourite=True) == [4] and ids(tags=["t", "u"]) == [1] and ids(deadline_year=["2024"]) == [1] and ids(modified_after=6, modified_before=6) == [2]
    rows, total = filters.page(filters.sort_by(filters.apply_filters(catalog, ListOptions()), catalog, "size_desc"), 1, 2)
    assert total() == 3 and [r.id for r in rows.collect()] == [1]


def test_components_with_salts(spark, monkeypatch):
    edges = spark.range(1, 200).selectExpr("id * 7 % 200 as src", "id * 3 % 50 as dst")
    rows = lambda: sorted((r.node, r.component) for r in graph.connected_components(edges).collect())
    own = rows()
    monkeypatch.setattr(graph, "SALTED_FROM", 0)
    assert rows() == own


def test_components_and_pairs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), (None, 1)], "src long, dst long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    assert graph.connected_components(edges.limit(0)).count() == 0
    chain = spark.range(400).selectExpr("id as src", "id + 1 as dst")
    assert graph.connected_components(chain).select("component").distinct().collect()[0][0] == 0


def test_hamming_pairs_are_exact(spark, monkeypatch):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base]
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
    assert {(r.a, r.b) for r in duplicates.hamming_pairs(df, "h", 3).collect()} == want
    monkeypatch.setattr(duplicates, "BLOCK", 2)
    monkeypatch.setattr(duplicates, "SMALL", 1)
    assert sorted((r.a, r.b) for r in duplicates.hamming_pairs(df, "h", 3).collect()) == sorted(want)
    monkeypatch.setattr(duplicates, "SMALL", 2)
    groups = {}
    for r in duplicates.visual_groups(df, "id", "h", 3).collect():
        groups.setdefault((r.component, r.score), set()).add(r.id)
    number = {h: i for i, h in enumerate(values)}
    for (first, score), ids in groups.items():
        inner = [(number[a], number[b], (a ^ b).bit_count()) for a, b in want if number[a] in ids]
        assert first == min(ids) and {i for a, b, _ in inner for i in (a, b)} == ids and score == 100 - (max(d for *_, d in inner) * 100 + 32) // 64


def test_relations(spark):
    assets = spark.createDataFrame([(1, "/p", "plan.dwg"), (2, "/p", "plan.pdf"), (3, "/p", "plan.bak"), (4, "/p", "rapor.doc"), (5, "/p", "rapor_v2.doc"), (6, "/p", "123.dwg"), (7, "/p", "123.pdf")], "id long, folder string, file_name string")
    pairs = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert (1, 2) in pairs(duplicates.derived_relations(assets)) and pairs(duplicates.version_relations(assets)) == [(4, 5)] and pairs(duplicates.backup_relations(assets)) == [(1, 3)]
    known = spark.createDataFrame([(5, 4, "x")], "src long, dst long, kind string")
    assert duplicates.new_relations(duplicates.version_relations(assets), known).count() == 0


def test_merge(spark):
    target = spark.createDataFrame([(1, "/a", "h1"), (7, "/b", "h2")], "id long, path string, content_hash string")
    source = spark.createDataFrame([(1, "/a", "h9"), (2, "/c", "h2"), (3, "/d", "h3"), (4, "/e", None)], "id long, path string, content_hash string")
    assert list(archive.merge_preview(target, source).first()) == [4, 1, 1]
    merged, ids = archive.merge_assets(target, source)
    assert sorted((r.path, r.id) for r in merged.collect()) == [("/a", 1), ("/b", 7), ("/d", 8), ("/e", 9)]
    side = spark.createDataFrame([(3, 4, "v"), (1, 3, "v")], "src long, dst long, kind string")
    assert [(r.src, r.dst) for r in archive.remap_side(side, ids, ["src", "dst"]).collect()] == [(8, 9)]


def test_snapshots_and_journal(spark, tmp_path):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    states = [spark.createDataFrame(x, "id long, name string") for x in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, None)], [(2, "c"), (3, "d")])]
    journal = tables.changes(states[0], states[0], "id", 0)
    for step in (1, 2):
        journal = tables.record(journal, tables.changes(states[step - 1], states[step], "id", step), step)
    back = tables.undo(states[2], journal, "id", 2)
    assert rows(back) == rows(states[1]) and rows(tables.undo(back, journal, "id", 1)) == rows(states[0])
    assert rows(tables.redo(tables.redo(states[0], journal, "id", 1), journal, "id", 2)) == rows(states[2])
    assert {r.step for r in tables.record(journal, tables.changes(states[0], states[2], "id", 2), 2).collect()} == {1, 2}
    tables.snapshot({"assets": states[2]}, f"file://{tmp_path}/one")
    assert rows(tables.restore(spark, f"file://{tmp_path}/one", ["assets"])["assets"]) == rows(states[2])
    assert tables.upgrade(states[0], {"id": "long", "kind": "string"}).columns == ["id", "kind"]


def test_soft_delete_and_patch(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "id long, deleted_at long, client string")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.deleted_at for r in tables.set_deleted(df, ids, 9).orderBy("id").collect()] == [9, 5]
    assert [r.client for r in tables.patch(df, [2], {"client": None}).orderBy("id").collect()] == ["x", None]
    with pytest.raises(ValueError):
        tables.patch(df, [1], {"approval_status": "maybe"})


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(1000)))), (2, "one"), (3, ""), (4, None)], "id long, text string")
    rows = chunking.word_windows(df, "id", "text").orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index, r.n_words) for r in rows] == [(1, 0, 500), (1, 1, 500), (1, 2, 100), (2, 0, 1)]
    spans = lambda t: [(m.start(), m.end()) for m in __import__("re").finditer(r"\S+", t)]
    assert chunking.token_windows(df, "id", "text", spans).filter("id = 1").count() == 6


def test_knn_matches_expression(spark):
    rows = spark.range(60).selectExpr("id", "array(cast(id % 7 as float), cast(id % 5 as float), cast(1 as float)) as v")
    found = similarity.knn(rows, rows.filter("id < 3"), "id", "id", "v", 4)
    pairs = rows.filter("id < 3").selectExpr("id as q", "v as g").crossJoin(rows).filter("q != id").select("q", "id", vectors.cosine(F.col("g"), F.col("v")).alias("s"))
    want = {q: [r[1] for r in sorted(((-round(r.s, 9), r.id) for r in pairs.filter(F.col("q") == q).collect()))[:4]] for q in range(3)}
    got = {q: [r.id for r in sorted(found.filter(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] for q in range(3)}
    scores = {(r.q, r.id): r.s for r in pairs.collect()}
    for q in range(3):
        assert [round(scores[q, i], 6) for i in got[q]] == [round(scores[q, i], 6) for i in want[q]]


def test_retrieval_gate_and_cap(spark):
    rows = [(i, i // 5, "alpha beta" if i < 5 else "alpha", [float(i == 9), 1.0]) for i in range(10)]
    chunks = spark.createDataFrame(rows, "chunk_id long, asset_id long, text string, embedding array<float>")
    found = retrieval.retrieve(chunks, "alpha beta", [1.0, 1.0]).orderBy("position").collect()
    assert [r.score for r in found[:3]] == [1.0] * 3 and all(r.asset_id == 0 for r in found[:3]) and len(found) == 6
    assert retrieval.diagnostics(retrieval.retrieve(chunks, "alpha beta", keyword_only=True)).first()["by_vector"] == 0


def test_stride_and_prefix(spark):
    df = spark.range(100).selectExpr("id", "concat('/root/', id) as p")
    assert sorted(r.id for r in aggregates.stride_sample(df, "id", 30).collect()) == list(range(0, 100, 4))
    assert aggregates.common_prefix(df, "p").first()[0] == "/root/"


def test_numbers_over_many_ranges(spark, monkeypatch):
    """Each range has its own task here, with adaptive execution on."""
    wanted = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        source = spark.range(20_000).selectExpr("id", "lpad(cast(id * 7919 % 20011 as string), 6, '0') as path", "cast(null as string) as content_hash", "repeat('x', 40) as fill")
        written = []
        monkeypatch.setattr(numbering, "materialize", lambda df, label: written.append(materialize(df, label)) or written[-1])
        numbered = numbering.number_rows(source, ["path"], "n", 5)
        rows = numbered.select("n", "path").orderBy("n").collect()
        assert [r.n for r in rows] == list(range(5, 20_005)) and [r.path for r in rows] == sorted(r.path for r in rows)
        assert len(written[0].inputFiles()) >= 8
        merged, ids = archive.merge_assets(source.filter("id < 3"), source)
        assert merged.count() == 20_000 and merged.select("id").distinct().count() == 20_000 and ids.count() == 19_997
        dim, _ = archive.reconcile_names(spark.createDataFrame([(9, "000001")], "id long, name string"), source.select("id", F.col("path").alias("name")))
        assert dim.count() == 20_000 and dim.agg(F.max("id")).first()[0] == 9 + 19_999
        assert aggregates.stride_sample(source.select("path"), "path", 5).count() == 1000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


INDEXED = {q: ids for q, ids in [("villa", [1, 3, 5]), ("villa OR ofis", [1, 2, 3, 5]), ("villa NOT salon", [1, 5]), ("villa AND salon", [3]), ('"villa bahce"', [1]), ("villa OR OR ofis", []), ("OR villa", []), ("and", [4]), ("(villa", [1, 3, 5]), ("roof and beam", [4, 5]), ("bulut", [5]), ("bul", []), ("villa plan", [1]), ("(ofis OR salon) plan", [2]), ("kat ve plan", []), ("villa veya ofis", [1, 2, 3, 5]), ("villa DEĞİL salon", [1, 5])]}


def test_search_over_the_index_equals_the_scan(spark, docs):
    index = fulltext.build_index(docs, "id", ["title", "body"])
    for query, ids in INDEXED.items():
        assert sorted(r.key for r in fulltext.search_index(index, query).collect()) == ids, query
        assert sorted(r.id for r in fulltext.search(docs, query, ["title", "body"]).collect()) == ids, query
    assert fulltext.search_index(index, " ") is None
    assert [r.key for r in fulltext.search_index(index, "ana kubbe", {"ana kubbe": ["salon"]}).collect()] == [3]
    assert {r.key: r.sources for r in fulltext.search_index(index, "villa NOT salon").collect()} == {1: ["title", "body"], 5: ["body"]}
    assert sorted(r.key for r in fulltext.fuzzy_index(index, "vila", ["title"]).collect()) == [1, 3]
    assert sorted(r.key for r in fulltext.keyword_ids(index, ["villa bahce", "ofis"]).collect()) == [1, 2]
    catalog = Catalog(docs.withColumns({"file_name": F.col("title"), "modified_at": F.col("id")}))
    listed = lambda **o: [r.id for r in fulltext.list_search(catalog, ListOptions(**o), index, names=("title",)).collect()]
    assert listed(query="") == [5, 4, 3, 2, 1] and sorted(listed(query="villa")) == [1, 3, 5] and listed(query="vila", fuzzy_last=True) == [3, 1] and listed(query="vila") == []
    one = spark.createDataFrame([("a plan", "a villa of villa")], "title string, body string").select(fulltext.best_snippet(["title", "body"], ["villa"]).alias("s")).first().s
    assert (one.field, one.text.count("[villa]")) == ("body", 2)
