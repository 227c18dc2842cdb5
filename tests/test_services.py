"""Side tables, codecs, exports and the files they come from, on small tables."""

import pytest
from pyspark.sql import functions as F

from strataq.functions import codec
from strataq.operators import classify, duplicates, exports, retrieval, services
from strataq.sources import readers


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_names_and_roots(spark):
    names = spark.createDataFrame([(1, "Villa"), (1, "Kat"), (2, "villa ")], "asset_id long, name string")
    assert rows(services.rename(names, "villa", "Kat")) == [(1, "Kat"), (2, "Kat")]
    assert rows(services.remove_links(names, spark.createDataFrame([("Kat",)], "name string"))) == [(1, "Villa"), (2, "villa ")]
    roots = spark.createDataFrame([(1, "C:\\Arsiv", "a", 5, None), (2, "/b", "b", 6, 9)], "id long, path string, label string, scanned_at long, deleted_at long")
    assert rows(services.record_scan(roots, "/B", "x", 7), "id", "scanned_at", "deleted_at") == [(1, 5, None), (2, 7, None)]
    assert rows(services.record_scan(roots, "/c", "x", 7), "id", "path") == [(1, "C:\\Arsiv"), (2, "/b"), (3, "/c")]
    assets = spark.createDataFrame([("c:/arsiv/x.dwg", None), ("C:\\ARSIV\\y\\z.dwg", None), ("C:/arsiv2/q", None), ("/b/1", 3)], "path string, deleted_at long")
    tags = spark.createDataFrame([(1, "t"), (1, "s")], "root_id long, name string")
    assert [(r.id, r.n, r.tags) for r in services.roots_with_counts(roots, assets, tags).collect()] == [(1, 2, ["s", "t"]), (2, 0, [])]


def test_moves_and_flags(spark):
    assets = spark.createDataFrame([(1, "/a/x.dwg", "x.dwg", "dwg", None), (2, "/a/y.pdf", "y.pdf", "pdf", None)], "id long, path string, file_name string, ext string, deleted_at long")
    moves = spark.createDataFrame([(1, "/b/Z.DXF"), (2, "/A/X.dwg")], "id long, new_path string")
    assert rows(services.refile(assets, moves), "id", "path", "file_name", "ext") == [(1, "/b/Z.DXF", "Z.DXF", "dxf"), (2, "/a/y.pdf", "y.pdf", "pdf")]
    ids = spark.createDataFrame([(2,)], "id long")
    flagged = services.set_flag(assets.withColumn("rag_excluded", F.lit(None).cast("boolean")), ids, "rag_excluded", True)
    assert rows(flagged, "id", "rag_excluded") == [(1, False), (2, True)]
    region = services.region_ids(spark.createDataFrame([(3, 4), (3, 9)], "asset_id long, region int"))
    assert rows(region, "id") == [(28,)] and rows(services.images_with_vectors(region)) == [(3, 1)]


def test_messages_and_registry(spark):
    none = spark.createDataFrame([], "id long, sender_id long, sender string, body string, created_at long")
    sent = services.send_message(services.send_message(none, 1, "a", " hi ", 5), 2, "b", "yo", 6)
    reads = services.mark_read(services.mark_read(spark.createDataFrame([], "message_id long, user_id long, read_at long"), 1, 2, 8), 1, 2, 9)
    assert rows(reads) == [(1, 2, 8)] and rows(services.received(sent, reads, 2), "id", "body", "read") == [(1, "hi", True)]
    with pytest.raises(ValueError):
        services.send_message(none, 1, "a", "  ", 5)
    archives = spark.createDataFrame([(1, "Ana", None, "a", 1, None)], "id long, name string, colour string, path string, created_at long, deleted_at long")
    with pytest.raises(ValueError):
        services.activate_archive(archives, "ana ", None, "b", 2)
    assert services.activate_archive(archives, "Yeni", "red", "b", 2).count() == 2
    assert rows(services.set_meta(services.set_meta(spark.createDataFrame([], "key string, value string"), "k", "1"), "k", "2")) == [("k", "2")]
    assert services.log_page(sent, 0, time="created_at").count() == 0


def test_timeline_and_groups(spark):
    relations = spark.createDataFrame([(1, 2), (3, 2), (7, 8)], "src long, dst long")
    assets = spark.createDataFrame([(1, 30), (2, 20), (3, 10), (7, 1), (9, 4)], "id long, modified_at long")
    line = lambda i: [r.id for r in services.timeline(relations, assets, i).collect()]
    assert line(1) == [3, 2, 1] and line(9) == [9] and line(5) == []
    groups = duplicates.duplicate_groups(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id long, k string"), F.col("k"), "id")
    assert rows(groups, "id", "n", "first") == [(1, 2, 1), (2, 2, 1)] and duplicates.groups_of(groups, 2).count() == 2 and duplicates.groups_of(groups, 3).count() == 0


def test_codecs_and_exports(spark, tmp_path):
    row = spark.createDataFrame([("data:image/png;base64,aGk=", "data:text/plain,x", ' "Acme" ', "a<b & 'c'")], "u string, v string, q string, x string").select(codec.data_url(F.col("u")).alias("u"), codec.data_url(F.col("v")).alias("v"), codec.unquoted(F.col("q")).alias("q"), codec.xml_escape(F.col("x")).alias("x")).first()
    assert (row.u.kind, bytes(row.u.content), row.v, row.q, row.x) == ("png", b"hi", None, "Acme", "a&lt;b &amp; &apos;c&apos;")
    chat = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a")], "s long, n long, role string, text string")
    exports.write_lines(exports.chat_lines(chat, "s", "n", "role", "text"), "s", "n", f"file://{tmp_path}/chat")
    text = "".join(r.value + "\n" for r in spark.read.text(f"file://{tmp_path}/chat/s=1").collect())
    assert text.index("a") < text.index("\nb") and text.startswith("### User")
    tagged = spark.createDataFrame([(1, "t"), (1, "s")], "asset_id long, name string")
    xml = exports.sidecars(spark.createDataFrame([(1, "x&y", None)], "id long, title string, kind string"), "id", {"title": "title", "type": "kind"}, tagged).first().xml
    assert "<dc:title>x&amp;y</dc:title>" in xml and "dc:type" not in xml and xml.index("<dc:subject>s") < xml.index("<dc:subject>t")
    assert retrieval.route(" a ") == "text" and retrieval.route("a", semantic=True) == "semantic" and retrieval.route("a", similar_to=3) == "similar" and retrieval.route(colour="#fff") == "colour" and retrieval.route(" ") == "browse"


IFC = """ISO-10303-21;
HEADER;
FILE_DESCRIPTION(('View [One]'),'2;1');
FILE_NAME('m.ifc','2024-01-01',('Ada','Bo'),('Studio'),'pre','Tool 7','');
FILE_SCHEMA(('IFC4'));
ENDSEC;
DATA;
#1=IFCPROJECT('g',$,'House of O''Neil',$);
#2= IFCBUILDINGSTOREY('g',#1,'Ground Floor',$);
#3=IFCBUILDINGSTOREY('g',#1,'First',$);
#4=IFCWALL('g');
ENDSEC;
"""


def test_model_header(spark):
    text, fields = readers.read_ifc(IFC.encode(), "ifc")
    assert text == "House of O'Neil\nAda, Bo\nStudio\nTool 7\nView [One]\nGround Floor\nFirst"
    assert fields == {"total_entities": "4", "top_entities": "IFCBUILDINGSTOREY:2, IFCPROJECT:1, IFCWALL:1", "storey_count": "2", "space_count": "0", "schema": "IFC4", "description": "View [One]", "author": "Ada, Bo", "organization": "Studio", "originating_system": "Tool 7", "project_name": "House of O'Neil", "storey_names": "Ground Floor; First"}


def test_backfill_and_reindex(spark, tmp_path):
    metadata = spark.createDataFrame([(1, "kind", "Render"), (2, "other", "x")], "asset_id long, key string, value_text string")
    assets = spark.createDataFrame([(1, "photo_a.jpg"), (2, "photo_b.jpg"), (3, "zzz.jpg")], "id long, file_name string")
    kind = classify.image_kind(F.col("file_name"), F.lit(""))
    once = services.backfill(metadata, assets, "kind", kind)
    assert rows(once.filter("key = 'kind'"), "asset_id", "value_text") == [(1, "Render"), (2, "Fotoğraf")]
    assert services.backfill(once, assets, "kind", kind).count() == once.count()
    for name in ("a.txt", "b.txt", "c.bin"):
        (tmp_path / name).write_text(f"text of {name}")
    again = readers.extract(spark, [f"file://{tmp_path}/a.txt", f"file://{tmp_path}/c.bin"])
    assert [(r.ext, r.text, len(r.content_hash)) for r in again.orderBy("ext").collect()] == [("bin", None, 64), ("txt", "text of a.txt", 64)]


def test_links_with_nulls(spark):
    links = spark.createDataFrame([(1, "a", None), (1, "b", "red"), (2, None, None)], "asset_id long, name string, colour string")
    gone = spark.createDataFrame([(1, "a", None), (2, None, None)], links.schema)
    assert [tuple(r) for r in services.remove_links(links, gone).collect()] == [(1, "b", "red")]
    assert [tuple(r) for r in services.toggle_links(links, gone).collect()] == [(1, "b", "red")]
    back = services.toggle_links(services.remove_links(links, gone), gone)
    assert sorted(map(str, back.collect())) == sorted(map(str, links.collect()))
    assert services.remove_links(links, gone.select("colour").distinct()).count() == 1


def test_refile_moves_an_asset_once(spark):
    assets = spark.createDataFrame([(1, "x/a.txt", "a.txt", "txt", None), (2, "x/b.txt", "b.txt", "txt", None), (3, "x/c.txt", "c.txt", "txt", None)], "id long, path string, file_name string, ext string, deleted_at long")
    moves = spark.createDataFrame([(1, "y/q.pdf"), (1, "y/p.md"), (2, "y/p.md"), (3, "X/B.TXT"), (9, "y/z")], "id long, new_path string")
    got = {r.id: (r.path, r.file_name, r.ext) for r in services.refile(assets, moves).collect()}
    assert got == {1: ("y/p.md", "p.md", "md"), 2: ("x/b.txt", "b.txt", "txt"), 3: ("x/c.txt", "c.txt", "txt")} and services.refile(assets, moves).count() == 3


def test_timeline_walks_a_long_chain(spark):
    assets = spark.range(40).selectExpr("id", "100 - id as modified_at")
    relations = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(7, 3), (20, 21), (21, 22)], "src long, dst long")
    assert [r.id for r in services.timeline(relations, assets, 4).collect()] == [7, 5, 4, 3, 2, 1, 0]
    assert [r.id for r in services.timeline(relations, assets, 30).collect()] == [30] and services.timeline(relations, assets, 99).count() == 0
