"""Searches for many queries at once: vectors by matrix parts and by cells, chunks by words and vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.operators import fulltext, retrieval, similarity


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in np.round(centres[i % 12] + 0.2 * rng.normal(size=8), 1)], i % 3) for i in range(600)]
    rows += [(1000 + i, [0.0] * 8, 0) for i in range(3)] + [(2000, rows[0][1], 0), (3000, None, 0)]
    return spark.createDataFrame(rows, "id long, v array<double>, kind int").repartition(5)


def plain_knn(rows, queries, k, metric, where=lambda r: True):
    out = {}
    for q in queries:
        found = []
        for r in rows:
            if r.v is None or r.id == q.id or not where(r):
                continue
            a, b = np.array(q.v), np.array(r.v)
            length = np.linalg.norm(a) * np.linalg.norm(b)
            score = (a @ b / length if length else 0.0) if metric == "cosine" else -np.linalg.norm(a - b)
            found.append((-round(score, 9), r.id))
        out[q.id] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_knn_in_parts_and_all_cells_are_exact(spark, vectors, metric, monkeypatch):
    monkeypatch.setattr(similarity, "SCORES", 1000)  # parts of a few vectors
    rows, queries = vectors.collect(), vectors.filter("id % 50 = 0 and v is not null")
    want = plain_knn(rows, queries.collect(), 7, metric)
    index = similarity.build_vector_index(vectors, "id", "v", metric, keep=("kind",))
    assert index.rows.count() == 604 and len(index.centres) == 98
    every = similarity.search_cells(index, queries, "id", "v", 7, len(index.centres))
    for got in (similarity.knn(vectors, queries, "id", "id", "v", 7, metric), every):
        found = {}
        for r in got.collect():
            found.setdefault(r.query_id, []).append((r.rank, round(r.score, 6), r.id))
        sign = 1 if metric == "l2" else -1
        for q, hits in want.items():
            assert [s for _, s, _ in sorted(found[q])] == pytest.approx([sign * s for s, _ in hits], abs=2e-6)
    some = similarity.search_cells(index, queries, "id", "v", 7, 50).collect()
    exact = {(q, i) for q, hits in want.items() for _, i in hits}
    assert len(exact & {(r.query_id, r.id) for r in some}) / len(exact) >= 0.9
    held = similarity.search_cells(index, queries, "id", "v", 7, len(index.centres), F.col("kind") == 1).collect()
    assert {r.id for r in held} <= {r.id for r in rows if r.kind == 1} and len(held) == 7 * len(want)
    probed = similarity.search_cells(index, queries.limit(1), "id", "v", 7, 1)
    assert "PushedFilters: [In(cell" in probed._jdf.queryExecution().toString() or "EqualTo(cell" in probed._jdf.queryExecution().toString()


def test_empty_vectors(spark, vectors):
    index = similarity.build_vector_index(vectors.limit(0), "id", "v")
    assert similarity.search_cells(index, vectors, "id", "v", 3, 5).count() == 0
    assert similarity.search_cells(similarity.build_vector_index(vectors, "id", "v"), vectors.limit(0), "id", "v", 3, 5).count() == 0


def test_many_queries_give_what_one_gives(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "İstanbul", "çatı"]
    chunks = [(i, i // 4, " ".join(rng.choice(words, 6)), [float(x) for x in rng.normal(size=3)] if i % 5 else None) for i in range(80)]
    df = spark.createDataFrame(chunks, "chunk_id long, asset_id long, text string, embedding array<double>")
    asked = [(1, "alpha beta", [1.0, 0.0, 0.0]), (2, "istanbul", None), (3, "missing", [0.0, 1.0, 0.0]), (4, "delta çatı gamma", [0.5, 0.5, 0.5]), (5, "", None)]
    requests = [(i, retrieval.query_tokens(q)[0], None, v) for i, q, v in asked]
    queries = spark.createDataFrame(requests, "query_id long, tokens array<string>, more array<string>, vector array<double>")
    index = retrieval.chunk_index(df)
    got = {}
    for r in retrieval.retrieve_many(index, df, queries).orderBy("position").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.asset_id, round(r.score, 6), r.text_rank, r.vector_rank))
    plain = df.withColumn("text", F.lower(F.translate("text", "İç", "ic"))).filter("embedding is not null or embedding is null")
    for i, q, v in asked:
        one = retrieval.retrieve(plain, q, v).orderBy("position").collect() if v is None else None
        if one is not None:
            assert [(r.chunk_id, round(r.score, 6)) for r in one] == [(c, s) for c, _, s, _, _ in got.get(i, [])]
    held = [c for c, _, t, _ in chunks if {"alpha", "beta"} <= set(t.split())]
    first = [c for c, _, s, _, _ in got[1] if s == 1]
    assert set(first) <= set(held) and first == [c for c, *_ in got[1]][: len(first)]
    counts = {}
    for c, a, *_ in got[1]:
        counts[a] = counts.get(a, 0) + 1
    assert max(counts.values()) <= retrieval.PER_ASSET and 5 not in got and all(t is None for _, _, _, t, _ in got[3])
    scope = spark.createDataFrame([(3,), (4,)], "asset_id long")
    scoped = retrieval.retrieve_many(index, df, queries, scope=scope, keyword_only=True).collect()
    assert {r.asset_id for r in scoped} <= {3, 4} and all(r.vector_rank is None for r in scoped)
    cells = similarity.build_vector_index(df, "chunk_id", "embedding", "l2")
    by_cells = retrieval.retrieve_many(index, df, queries, vectors=cells, probes=len(cells.centres)).orderBy("position").collect()
    again = {}
    for r in by_cells:
        again.setdefault(r.query_id, []).append((r.chunk_id, r.asset_id, round(r.score, 6), r.text_rank, r.vector_rank))
    assert again == got


def test_field_snippets(spark):
    long = "x " * 30 + "The Licence, (roof) detail; of a BEAM. " + "y " * 30
    rows = [(1, "beam", long), (2, None, "no hit here"), (3, "Beam roof", "beams, beam! end"), (4, "roof", None)]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    index = fulltext.build_index(df, "id", ["title", "body"])
    got = {(r.id, r.field): r.snippet for r in fulltext.field_snippets(index, df, "id", '"beam" NOT garage', width=4).collect()}
    assert got == {(1, "title"): "[beam]", (1, "body"): "…[BEAM]. y y y…", (3, "title"): "[Beam] roof", (3, "body"): "…[beam]! end"}
    both = {(r.id, r.field): r.snippet for r in fulltext.field_snippets(index, df, "id", '"beam" OR "roof"', width=6).collect()}
    assert both[1, "body"] == "…([roof]) detail; of a [BEAM]. y…".replace("(", "", 1) or both[1, "body"] == "…[roof]) detail; of a [BEAM]. y…"
    assert both[4, "title"] == "[roof]" and fulltext.field_snippets(index, df, "id", " ").count() == 0


def test_vocabulary_in_its_order():
    vocabulary = {"merdiven": ["stair", "staircase", "basamak"], "han": ["kervansaray"], "kat planı": ["floor plan", "PLAN"], "cati kati": ["attic", "çatı"]}
    assert retrieval.query_tokens("Merdiven nerede", vocabulary) == (["merdiven", "nerede"], ["merdiven", "nerede", "stair", "staircase", "basamak"])
    assert retrieval.query_tokens("villa hangi dosyada", vocabulary)[1] == ["villa", "dosyada"]
    assert retrieval.query_tokens("zemin kat plani lazim", vocabulary)[1] == ["zemin", "kat", "plani", "lazim", "floor", "plan"]
    assert fulltext.expanded_tokens("merdiven çatı katı", vocabulary, most=4) == ["stair", "staircase", "basamak", "attic"]
    assert fulltext.expanded_tokens("xyzzy", vocabulary) == []
