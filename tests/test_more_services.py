"""Roots, archives, exports, token windows, folders and lists."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataq.operators import archive, chunking, classify, retrieval, services, tables


def test_roots(spark):
    roots = spark.createDataFrame([(1, "c:/a", "A", None, None), (2, "c:/b", "B", 5, None), (3, "c:/c", "C", 9, 4)], "id long, path string, label string, deleted_at long, group_id long")
    assets = spark.createDataFrame([("c:/a/x", None), ("c:/b/y", None), ("c:/b/z", 1)], "path string, deleted_at long")
    tags = spark.createDataFrame([(1, "t"), (2, "u")], "root_id long, name string")
    trashed = services.set_root_state(roots, [1, 2], 7)
    assert {r.id: r.deleted_at for r in trashed.collect()} == {1: 7, 2: 5, 3: 9}
    assert {r.id: r.deleted_at for r in services.set_root_state(trashed, [2], None).collect()} == {1: 7, 2: None, 3: 9}
    left, names = services.purge_roots(roots, tags, [1, 2])
    assert sorted(r.id for r in left.collect()) == [1, 3] and [r.root_id for r in names.collect()] == [1]
    assert {r.id: r.group_id for r in services.group_roots(roots, [1, 3], 8).collect()} == {1: 8, 2: None, 3: 8}
    assert [(r.id, r.n) for r in services.list_roots(roots, assets, tags=tags).collect()] == [(1, 1)]
    assert [(r.id, r.n) for r in services.list_roots(roots, assets, trashed=True).collect()] == [(3, 0), (2, 1)]


def test_registry_messages_and_reports(spark):
    archives = spark.createDataFrame([(1, "One", "red", None), (2, "Two", None, None), (3, "Old", None, 4)], "id long, name string, colour string, deleted_at long")
    assert {r.id: (r.name, r.colour) for r in services.change_archive(archives, 2, "Old", "blue").collect()}[2] == ("Old", "blue")
    assert services.change_archive(archives, 1, deleted_at=9).filter("id = 1").first().deleted_at == 9
    for bad in (" one ", "  "):
        with pytest.raises(ValueError):
            services.change_archive(archives, 2, bad)
    messages = spark.createDataFrame([(1, None, None), (2, 7, 70)], "id long, resolved_by long, resolved_at long")
    done = services.resolve_message(services.resolve_message(messages, 1, 5, 50), 2, 6, 60)
    assert {r.id: (r.resolved_by, r.resolved_at) for r in done.collect()} == {1: (5, 50), 2: (7, 70)}
    reports = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id long, ts long")
    lines = spark.createDataFrame([(1, "added"), (1, "added"), (1, "failed"), (3, "added")], "report_id long, kind string")
    assert [(r.id, r.lines) for r in services.report_summaries(reports, lines).collect()] == [(3, {"added": 1}), (2, {}), (1, {"added": 2, "failed": 1})]
    assets = spark.createDataFrame([(3, "c", None), (1, "a", None), (2, "b", 5)], "id long, path string, deleted_at long")
    assert [r.path for r in services.path_sample(assets, 2).collect()] == ["a", "c"]
    assert [r.id for r in tables.flag_changes(assets, spark.range(5), "deleted_at", 5).orderBy("id").collect()] == [1, 3]


def test_export_and_import(spark, tmp_path):
    folder = f"file://{tmp_path}/export"
    made = {"assets": spark.range(5), "tags": spark.createDataFrame([(1, "x")], "id long, name string")}
    tables.export_archive(made, folder, "a1", 99)
    seen = tables.peek(spark, folder)
    assert (seen["id"], seen["version"], seen["exported_at"], seen["names"], seen["counts"]) == ("a1", tables.VERSION, 99, ["assets", "tags"], {"assets": 5, "tags": 1})
    back = tables.import_archive(spark, folder)
    assert sorted(r.id for r in back["assets"].collect()) == [0, 1, 2, 3, 4] and back["tags"].first().name == "x"
    spark.range(2).write.mode("append").parquet(f"{folder}/assets")
    with pytest.raises(ValueError):
        tables.import_archive(spark, folder)
    archive.check_merge({"id": "a", "version": 2}, {"id": "b", "version": 2})
    for bad in ({"id": "a", "version": 2}, {"id": "b", "version": 3}):
        with pytest.raises(ValueError):
            archive.check_merge({"id": "a", "version": 2}, bad)


def test_token_windows_fit_when_encoded_again(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")

    def spans(text):
        return Tokenizer.from_file(path).encode(text, add_special_tokens=False).offsets

    texts = [(1, "merhaba dünya " * 60), (2, "kısa"), (3, ""), (4, None), (5, "şğüöçı" * 40), (6, "a b " * 30)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {}
    for r in chunking.token_windows(df, "id", "text", spans, size=20, overlap=4).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.chunk)
    tok = Tokenizer.from_file(path)
    assert set(got) == {1, 2, 5, 6} and got[2] == ["kısa"]
    for i, t in texts:
        if i in got:
            assert all(len(tok.encode(c, add_special_tokens=False).ids) <= 20 for c in got[i])
            assert got[i][0] and t.strip().startswith(got[i][0]) and t.strip().endswith(got[i][-1])


def test_folders_states_and_lists(spark):
    rows = spark.createDataFrame([("DWG", "approved", "2024-05-01"), ("png", "draft", " 2023/1"), ("xyz", "odd", "24-01"), (None, None, None), ("zip", "rejected", "2022"), ("7z", "review", "20245-1")], "e string, a string, d string")
    got = [tuple(r) for r in rows.select(classify.ext_folder(F.col("e")), classify.approval_folder(F.col("a")), classify.year_folder(F.col("d"))).collect()]
    assert got == [("01-Cizimler", "Onayli", "2024"), ("02-Gorseller", "Bekleyen", "2023"), ("00-Diger", "00-Belirsiz", "00-Terminsiz"), ("00-Diger", "00-Belirsiz", "00-Terminsiz"), ("07-Arsivler", "Reddedilen", "2022"), ("07-Arsivler", "Bekleyen", "00-Terminsiz")]
    catalog = spark.createDataFrame([("z:/x", 5), ("c:/y", 5), ("c:/w", 5)], "path string, modified_at long")
    listing = spark.createDataFrame([("c:/w", 9)], "path string, modified_at long")
    assert {r.path: r.state for r in archive.staleness(catalog, listing, offline=["z:"]).collect()} == {"z:/x": "offline", "c:/y": "missing", "c:/w": "stale"}
    results = spark.range(120).select((F.col("id") + 1).cast("int").alias("position"), (F.col("id") % 60).alias("asset_id"))
    files, counts = retrieval.file_list(results)
    assert files.count() == 50 and tuple(counts.first()) == (50, True)
    assert tuple(retrieval.file_list(results.filter("asset_id < 3"), 100)[1].first()) == (3, False) and tuple(retrieval.file_list(results.filter("asset_id < 3"), 6)[1].first()) == (3, True)
    assert [retrieval.clamped(k) for k in (-1, 0, 7, 900)] == [50, 50, 7, 200]
