"""Steps that must hold a bounded part at a time, or shuffle nothing, against plain versions."""

import math

import numpy as np
import pyarrow as pa
import pytest

from strataq.functions import contours, vectors
from strataq.operators import duplicates, fulltext, retrieval, similarity


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_is_built_without_a_shuffle(spark, monkeypatch):
    plans, real = [], fulltext.materialize
    monkeypatch.setattr(fulltext, "materialize", lambda df, label: plans.append(_plan(df)) or real(df, label))
    rows = [(1, "b a b", "x"), (2, None, ""), (3, "a", "a a c")]
    index = fulltext.build_index(spark.createDataFrame(rows, "id long, t string, s string"), "id", ["t", "s"])
    got = sorted((r.term, r.key, r.field, r.doc_length, list(r.positions)) for r in index.postings.collect())
    assert got == [("a", 1, "t", 4, [1]), ("a", 3, "s", 4, [0, 1]), ("a", 3, "t", 4, [0]), ("b", 1, "t", 4, [0, 2]), ("c", 3, "s", 4, [2]), ("x", 1, "s", 4, [0])]
    assert (index.n, index.mean) == (3, 8 / 3) and plans and not any("Exchange" in p for p in plans)


def test_postings_of_repeated_keys_are_merged(spark):
    rows = [(1, "a b"), (1, "b a"), (2, "a"), (None, "c"), (None, "c"), (3, "a a"), (3, "a")]
    df = spark.createDataFrame(rows, "id long, t string")
    want = [("a", 1, 2, [0, 1]), ("a", 2, 1, [0]), ("a", 3, 1, [0]), ("a", 3, 2, [0, 1]), ("b", 1, 2, [0, 1]), ("c", None, 1, [0, 0])]
    order = lambda x: (x[0], x[1] or 0, x[2])
    assert sorted(((r.term, r.key, r.doc_length, list(r.positions)) for r in fulltext.build_index(df, "id", ["t"]).postings.collect()), key=order) == want
    assert sorted(((r.term, r.id, r.length, list(r.positions)) for r in fulltext.token_index(df, "id", ["t"]).collect()), key=order) == want


def test_snippets_shuffle_the_texts_of_hits_alone(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a beam here" if i % 3 else "none") for i in range(30)], "id long, t string")
    index = fulltext.build_index(df, "id", ["t"])
    near = fulltext.field_snippets(index, df, "id", "beam")
    monkeypatch.setattr(fulltext, "BROADCAST_KEYS", -1)
    rows = lambda x: sorted((r.id, r.field, r.snippet) for r in x.collect())
    assert "LeftSemi" in _plan(near) and rows(near) == rows(fulltext.field_snippets(index, df, "id", "beam")) == [(i, "t", "…[beam] here") for i in range(30) if i % 3]


def test_group_scores_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, f"g{i % 7}" if i % 11 else None, rng.normal(size=4).tolist() if i % 13 else [0.0] * 4) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    monkeypatch.setattr(similarity, "SCORES", 64)
    monkeypatch.setattr(similarity, "ROWS", 16)
    got = {(r.query_id, r.g): r.score for r in similarity.best_per_group(df, df.filter("id % 10 = 0"), "g", "id", "v").collect()}
    want = {}
    for q, _, a in rows[::10]:
        for _, g, b in rows:
            n = np.linalg.norm(a) * np.linalg.norm(b)
            if g is not None:
                want[q, g] = max(want.get((q, g), -2), np.dot(a, b) / n if n else 0.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_outlines_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    grey = lambda: np.kron(rng.integers(0, 256, (8, 8)), np.ones((4, 4), int)).ravel().tolist()
    rows = [(i, grey(), 32) for i in range(11)] + [(11, None, 32), (12, [1, 2, 3], 2), (13, [], 1), (14, [5] * 64, 8), (15, [5] * 64, None)]
    df = spark.createDataFrame(rows, "id long, p array<int>, w int")
    monkeypatch.setattr(contours, "IMAGES", 3)
    got = {r.id: r for r in contours.outlines(df, "p", "w", ["id"]).collect()}
    assert len(got) == len(rows) and got[11].error == got[15].error == "no image" and "fill" in got[12].error and "fill" in got[13].error
    for i, p, _ in rows[:11]:
        image = np.array(p, np.uint8).reshape(32, 32)
        corners, n = contours.outline(image)
        assert [(q.x, q.y) for q in got[i].points] == [(float(x), float(y)) for x, y in corners] and got[i].contour_points == n
        assert (got[i].threshold, got[i].drawn, got[i].error) == (contours.otsu_threshold(image), contours.foreground(image).sum(), None)
    raw = spark.createDataFrame([(i, bytes(p), 32) for i, p, _ in rows[:11]], "id long, p binary, w int")
    assert {r.id: r for r in contours.outlines(raw, "p", "w", ["id"]).collect()} == {i: got[i] for i in range(11)}


def test_text_hashes_in_parts(spark, monkeypatch):
    texts = ["a b c " * k for k in range(20)] + [None, "", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    hashes = lambda: {r.id: r.h for r in df.select("id", vectors.text_hash(df.t).alias("h")).collect()}
    whole = hashes()
    monkeypatch.setattr(vectors, "HASHED", 40)
    assert hashes() == whole and whole[20] == whole[21] == 0 != whole[3]


def test_pairs_of_a_crowded_band_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "SMALL", 2)
    values = [int(x) for x in np.random.default_rng(3).integers(0, 1 << 12, 300)]
    found = duplicates.hamming_pairs(spark.createDataFrame([(v,) for v in values], "h long"), "h", 3, 63)
    assert "FlatMapGroupsInArrow" in _plan(found)
    distinct = sorted(set(values))
    want = sorted((a, b, (a ^ b).bit_count()) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3)
    assert sorted((r.a, r.b, r.d) for r in found.collect()) == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_text_candidates_are_the_best_of_parts(spark, kind, monkeypatch):
    rng = np.random.default_rng(9)
    vocabulary = np.array([f"word{i}" for i in range(12)])
    texts = {i: " ".join(rng.choice(vocabulary, rng.integers(1, 9))) for i in range(150)} | {150: "", 151: None}
    name = lambda i: i if kind == "long" else f"c{i:03}"
    df = spark.createDataFrame([(name(i), t) for i, t in texts.items()], f"chunk_id {kind}, text string")
    asked = {1: (["word1", "word2"], None), 2: (["word3"], ["word4", "word3"]), 3: (["word5", "missing"], []), 4: ([], None), 5: (["missing"], None), 6: (vocabulary.tolist(), None), 7: ([], ["word7"])}
    queries = spark.createDataFrame([(q, *a) for q, a in asked.items()], "query_id long, tokens array<string>, more array<string>")
    for part, value in {"PARTS": 3, "PART": 100, "POSTINGS": 40, "QUERIES": 3}.items():
        monkeypatch.setattr(retrieval, part, value)
    found = retrieval.text_candidates(retrieval.chunk_index(df), queries, 10)
    rows, plan = found.collect(), _plan(found)
    assert "MapInArrow" in plan and "Aggregate" not in plan  # no row per query and chunk
    assert "ReusedExchange" in plan  # blocks of queries share what was dealt
    tokens = {i: (t or "").split() for i, t in texts.items()}
    mean, held = sum(map(len, tokens.values())) / len(tokens), lambda w: sum(w in t for t in tokens.values())
    want = {}
    for q, (own, more) in asked.items():
        scores = {}
        for i, t in tokens.items():
            for w in {*own, *(more or [])} & {*t}:
                idf = math.log(1 + (len(tokens) - held(w) + 0.5) / (held(w) + 0.5))
                scores[i] = scores.get(i, 0) + idf * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
        for rank, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:10], 1):
            want[q, name(i)] = (rank, bool(own) and {*own} <= {*tokens[i]})
    assert {(r.query_id, r.chunk_id): (r.text_rank, r.gated) for r in rows} == want
    assert retrieval.text_candidates(retrieval.chunk_index(df), queries.limit(0), 10).count() == 0
    assert retrieval.text_candidates(retrieval.chunk_index(df.limit(0)), queries, 10).count() == 0


def test_candidates_of_repeated_chunks(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a"), (None, "a a b")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, ["a", "b"], None)], "query_id long, tokens array<string>, more array<string>")
    assert {r.chunk_id: r.gated for r in retrieval.text_candidates(retrieval.chunk_index(df), queries).collect()} == {1: True, 2: False, None: True}


@pytest.mark.parametrize("bits,crowd,leaf", [(12, 20, 4), (63, 30, 8), (64, 1 << 18, 8), (64, 5, 2)])
def test_crowded_bands_are_cut_again(spark, bits, crowd, leaf, monkeypatch):
    for name, value in {"SMALL": 2, "CROWD": crowd, "BLOCK": leaf, "FOUND": 5}.items():
        monkeypatch.setattr(duplicates, name, value)
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 3) if bits == 64 else rng.integers(0, 1 << bits, 3)
    values = [int(b) for b in base] * 2 + [int(np.bitwise_xor.reduce([base[i % 3], *(np.uint64(1 << int(k)).view(np.int64) for k in rng.integers(0, bits, 4))])) for i in range(250)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long").repartition(3)
    mask = (1 << 64) - 1
    want = sorted((a, b, ((a ^ b) & mask).bit_count()) for a in set(values) for b in set(values) if a < b and ((a ^ b) & mask).bit_count() <= 3)
    assert sorted((r.a, r.b, r.d) for r in duplicates.hamming_pairs(df, "h", 3, bits).collect()) == want
    least = {v: v for v in values}
    for _ in range(len(least)):
        before = dict(least)
        for a, b, _d in want:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    members, worst = {}, {}
    for i, v in enumerate(values):
        members.setdefault(least[v], []).append(i)
    for a, _b, d in want:
        worst[least[a]] = max(worst.get(least[a], 0), d)
    groups = {i: (min(own), 100 - (worst.get(c, 0) * 100 + 32) // 64) for c, own in members.items() if len(own) > 1 for i in own}
    assert {r.id: (r.component, r.score) for r in duplicates.visual_groups(df, "id", "h", 3, bits).collect()} == groups


def test_hashes_of_a_crowded_band_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "SMALL", 2)
    values = np.unique(np.random.default_rng(8).integers(0, 1 << 14, 9000)) << 20  # three of four bands share one value
    _, rows = duplicates._blocks(spark.createDataFrame([(int(v),) for v in values], "h long"), "h", 3, 63)
    assert rows.count() <= 4 * len(values)
    near = sum(len(a) for a, _, _ in duplicates._near(values, 1, 3, 63))
    assert near == sum(np.count_nonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) for i in range(len(values)))


def test_postings_are_scored_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(12)
    rows = sorted({(int(c), int(t)) for c, t in rng.integers(0, (60, 9), (300, 2))})
    table = pa.table({"chunk_id": [c for c, _ in rows], "no": pa.array([t for _, t in rows], pa.int32()), "tf": pa.array(rng.integers(1, 4, len(rows)), pa.int32()), "doc_length": pa.array([20 + c % 5 for c, _ in rows], pa.int32())})
    terms = [[{"no": int(t), "own": int(i != 2), "df": 30} for i, t in enumerate(rng.choice(9, n, replace=False))] for n in (1, 2, 3, 5, 9)]
    kind = pa.list_(pa.struct([("no", pa.int32()), ("own", pa.int32()), ("df", pa.int64())]))
    asked = retrieval._Asked(pa.table({"query_id": [10, 20, 30, 40, 50], "asked": pa.array([1, 2, 2, 4, 8], pa.int32()), "terms": pa.array(terms, kind)}), 60)

    def best(size):
        found = [row for part in retrieval._best_texts(asked, iter(table.to_batches(max_chunksize=size)), 21.0, 7) for row in zip(*(c.tolist() if isinstance(c, np.ndarray) else c.to_pylist() for c in part))]
        return sorted(found)

    whole = best(1000)
    assert len(whole) == 35 and any(g for *_, g in whole) and not all(g for *_, g in whole)
    held = {c: {t for d, t in rows if d == c} for c, _ in rows}
    assert all(g == ({x["no"] for x in terms[q // 10 - 1] if x["own"]} <= held[c]) for q, c, _, g in whole)
    for postings, size in ((1, 1), (7, 3), (40, 11), (1, 1000)):
        monkeypatch.setattr(retrieval, "POSTINGS", postings)
        assert best(size) == whole
