import random
import time
import zipfile

from pyspark.sql import functions as F

from strataq.sources import readers
from strataq.streaming import changes, incremental, progress, rates


def test_extract_and_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n3;4\n")
    (tmp_path / "b.txt").write_bytes("şehir".encode("cp1254"))
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    (tmp_path / "d.ifc").write_text("ISO-10303-21;\nFILE_SCHEMA(('IFC4'));\n#1=IFCPROJECT('g',$,'Ev',$);\n#2=IFCSPACE('s',$,'o',$);\n#3=IFCSPACE('t',$,'p',$);\n")
    (tmp_path / "e.dxf").write_text("0\nSECTION\n2\nTABLES\n0\nLAYER\n2\nDUVAR\n0\nTEXT\n1\nmerhaba\n9\n$ACADVER\n1\nAC1015\n")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:r>iki</w:r><w:r> söz</w:r></w:p></w:d>')
    (tmp_path / "g.docx").write_bytes(b"broken")
    (tmp_path / "Thumbs.db").write_bytes(b"x")
    root = f"file:{tmp_path}"
    found = {r.path.rpartition("/")[2]: r for r in readers.extract(spark, root).collect()}
    assert found["a.csv"].fields["csv_row_count"] == "3" and found["a.csv"].fields["csv_column_count"] == "2"
    assert found["b.txt"].text == "şehir" and found["b.txt"].fields["encoding_hint"] == "windows-1254"
    assert found["c.bin"].text is None and found["c.bin"].error is None and len(found["c.bin"].content_hash) == 64
    assert found["d.ifc"].fields["schema"] == "IFC4" and found["d.ifc"].fields["space_count"] == "2" and found["d.ifc"].fields["project_name"] == "Ev"
    assert found["e.dxf"].text == "merhaba" and found["e.dxf"].fields["layers"] == "DUVAR" and found["e.dxf"].fields["version"] == "AC1015"
    assert found["f.docx"].text == "iki söz" and found["g.docx"].error
    listed = readers.scan(spark, root)
    assert {r.file_name: r.skipped for r in listed.collect()}["Thumbs.db"] == "system_file"
    assert readers.changed(listed, listed.filter("ext = 'csv'")).count() == 6


def test_sniff_and_html(spark):
    df = spark.createDataFrame([(1, bytearray(b"%PDF-1.4"), "<title>T</title><script>x</script><p>a &amp; b</p>"), (2, bytearray(b"??"), None)], "id long, c binary, h string")
    assert [r[0] for r in df.select(readers.sniff(F.col("c"))).collect()] == ["pdf", "unknown"]
    assert [tuple(r) for r in readers.extract_html(df, "id", "h").collect()] == [(1, "T", "T a & b"), (2, None, None)]


def test_rates(spark):
    rows = [(i, "a", float(i) * 0.3) for i in range(8)] + [(99, "b", 0.0)]
    df = spark.createDataFrame(rows, "id long, k string, t double").withColumn("t", F.timestamp_seconds("t"))
    got = {r.id: r.allowed for r in rates.rate_decisions(df, "k", "t", "id", 1.0, 2).collect()}
    assert [got[i] for i in range(8)] == [True, True, False, False, True, True, False, False] and got[99]
    locks = rates.lockouts(df, "k", "t", limit=5, window=300).collect()
    assert [(r.k, r.locked_from.timestamp(), r.locked_until.timestamp()) for r in locks] == [("a", 1.2, 301.2)]


def test_rate_stream(spark, tmp_path):
    folder = f"file:{tmp_path}/in"
    spark.range(5).selectExpr("'a' as k", "timestamp_seconds(id) as t").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("k string, t timestamp").parquet(folder)
    query = rates.rate_stream(stream, "k", "t", seconds=10, limit=3).writeStream.format("memory").queryName("rated").option("checkpointLocation", f"file:{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.allowed for r in spark.sql("select allowed from rated").collect()) == [False, False, True, True, True]


def test_incremental_index(spark, tmp_path):
    source, index = f"file:{tmp_path}/src", f"file:{tmp_path}/index"
    build = lambda df: df.selectExpr("id", "upper(t) as t")
    run = lambda: incremental.index_new(spark, source, "id long, t string", index, f"file:{tmp_path}/cp", build, "id").awaitTermination(120)
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.parquet(source)
    run()
    spark.createDataFrame([(2, "again"), (3, "c")], "id long, t string").write.mode("append").parquet(source)
    run()
    assert sorted((r.id, r.t) for r in spark.read.parquet(index).collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_throttle_and_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.7), ("a", 1.2), ("b", 0.2)], "k string, t double").withColumn("t", F.timestamp_seconds("t"))
    assert incremental.throttle(df, "k", "t").count() == 3
    folder = f"file:{tmp_path}/ev"
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    query = incremental.windowed_counts(stream, "t", "k", "1 second").writeStream.outputMode("update").format("memory").queryName("counted").option("checkpointLocation", f"file:{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(r.n for r in spark.sql("select n from counted").collect()) == 4


def plain_locks(times, limit, window, lock):
    """A failure at a time, one after the other."""
    opened = until = None
    used, found = 0, []
    for t in sorted(times):
        if until is not None and t < until:
            continue
        if until is not None or opened is None or t - opened >= window:
            opened, used, until = t, 0, None
        used += 1
        if used >= limit:
            found.append(t)
            until = t + lock
    return found


def test_lockouts_equal_a_plain_loop(spark):
    rng = random.Random(9)
    times = {k: [rng.randrange(4000) for _ in range(rng.choice([0, 1, 5, 400]))] for k in "abcdefgh"}
    times["hot"] = [rng.randrange(200_000) for _ in range(60_000)]
    times["verdict"] = [*range(0, 100, 10), 400]
    rows = [(k, t) for k, ts in times.items() for t in ts] + [(None, 3), ("a", None)]
    df = spark.createDataFrame(rows, "k string, t long").withColumn("t", F.timestamp_seconds("t")).repartition(5)
    for limit, window, lock in ((5, 300, 300), (1, 10, 20), (3, 50, 0), (40, 100, 1000)):
        got = {}
        for r in rates.lockouts(df, "k", "t", limit, window, lock).collect():
            assert r.locked_until.timestamp() - r.locked_from.timestamp() == lock
            got.setdefault(r.k, []).append(int(r.locked_from.timestamp()))
        want = {k: plain_locks(ts, limit, window, lock) for k, ts in times.items()}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert plain_locks(times["verdict"], 5, 300, 300) == [40]
    assert rates.lockouts(df.limit(0), "k", "t").count() == 0


def test_lockout_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, out = f"file:{tmp_path}/in", f"file:{tmp_path}/out"
    times = [0, 1, 2, 3, 50, 51, 52, 53, 54, 55, 400, 401, 402]

    def run(part):
        spark.createDataFrame([("a", t) for t in part], "k string, t long").withColumn("t", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k string, t timestamp").parquet(folder)
        rates.lockout_stream(stream, "k", "t", 3, 1000, 52).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file:{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)

    for part in (times[:2], times[2:7], times[7:]):
        run(part)
    assert sorted(int(r.locked_from.timestamp()) for r in spark.read.parquet(out).collect()) == plain_locks(times, 3, 1000, 52) == [2, 400]


def test_throttle_is_a_gap_from_the_last(spark):
    rows = [("a", t) for t in (0.9, 1.1, 1.8, 1.95, 2.85, 2.9)] + [("b", 5.0), ("b", 5.0)]
    df = spark.createDataFrame(rows, "k string, t double").withColumn("t", F.timestamp_seconds("t"))
    assert sorted((r.k, round(r.t.timestamp(), 2)) for r in incremental.throttle(df, "k", "t").collect()) == [("a", 0.9), ("a", 1.95), ("b", 5.0)]


def test_folder_changes(spark, tmp_path):
    folder, out, cp = f"file:{tmp_path}/listings", f"file:{tmp_path}/changes", f"file:{tmp_path}/cp"
    schema = "root string, path string, size_bytes long, modified_at long, listed_at timestamp"
    changes.use_keyed_state(spark)
    listings = [
        (100, [("r", "a", 1, 1), ("r", "b", 1, 1), ("s", "a", 1, 1)]),
        (110, [("r", "a", 2, 1), ("r", "b", 1, 1), ("s", "a", 1, 1)]),  # a modified
        (110, [("r", "a", 2, 1), ("r", "b", 1, 1)]),  # the same listing again
        (105, [("r", "a", 9, 9)]),  # a late one
        (120, [("r", "a", 2, 1), ("r", "c", 1, 1), ("s", "a", 1, 1)]),  # c created, b gone
        (130, [("r", "a", 2, 1), ("r", "c", 1, 1), ("s", "a", 1, 1)]),
        (140, [("r", "a", 2, 1), ("r", "b", 1, 1), ("r", "c", 1, 1)]),  # b is back, a of s gone
        (150, [("r", "a", 2, 1), ("r", "b", 1, 1), ("r", "c", 1, 1)]),
        (160, [("r", "a", 2, 1), ("r", "b", 1, 1), ("r", "c", 1, 1)]),
    ]
    try:
        for part in (listings[:2], listings[2:6], listings[6:]):  # each is a run of its own: state comes back from the checkpoint
            for at, rows in part:
                spark.createDataFrame([(*r, at) for r in rows], schema.replace("timestamp", "long")).withColumn("listed_at", F.timestamp_seconds("listed_at")).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
            changes.folder_changes(stream, every=10).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((int(r["at"].timestamp()), r.root, r.path, r.kind) for r in spark.read.parquet(out).collect())
    assert got == [
        (100, "r", "a", "created"), (100, "r", "b", "created"), (100, "s", "a", "created"), (110, "r", "a", "modified"),
        (120, "r", "b", "removed"), (120, "r", "c", "created"), (140, "r", "b", "created"), (140, "s", "a", "removed"),
    ]
    table = lambda at: spark.createDataFrame([(*r, at) for r in dict(listings)[at]], schema.replace("timestamp", "long"))
    between = {(r.root, r.path): r.kind for r in changes.listing_changes(table(100), table(120)).collect()}
    assert between == {("r", "a"): "modified", ("r", "b"): "removed", ("r", "c"): "created"}


def test_progress_log(spark, tmp_path):
    folder = f"file:{tmp_path}/in"
    for i in range(6):
        spark.range(10).withColumn("part", F.lit(i)).coalesce(1).write.mode("append").parquet(folder)
    log = progress.ProgressLog(spark, f"file:{tmp_path}/progress", {"copying": 60}, gap=0.1)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long, part int").option("maxFilesPerTrigger", 1).parquet(folder)
        query = stream.writeStream.format("noop").queryName("copying").option("checkpointLocation", f"file:{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(100):
            if log.processed.get("copying") == 60 and not log.names:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    rows = progress.read_progress(spark, f"file:{tmp_path}/progress").filter("stage = 'copying'").collect()
    counts, times = [r.processed for r in rows], [r["at"] for r in rows]
    assert counts == sorted(set(counts)) and counts[-1] == 60 and {r.total for r in rows} == {60} and [r.n for r in rows] == list(range(len(rows)))
    assert all(b - a >= 0.1 for a, b in zip(times[:-1], times[1:-1]))


def test_progress_of_steps_is_throttled(spark, tmp_path):
    now = [0.0]
    log = progress.ProgressLog(spark, f"file:{tmp_path}/steps", {"a": 100}, clock=lambda: now[0])
    for _ in range(100):
        log.add("a", 1)
        now[0] += 0.04
    rows = progress.read_progress(spark, f"file:{tmp_path}/steps").collect()
    assert [r.processed for r in rows][:3] == [1, 5, 9] and rows[-1].processed == 100 and len(rows) == 26
