"""The registered queries over whole small tables, against their contracts by plain versions."""

import hashlib
import re
import zlib

import pytest

from strataq.llm import queries

from .test_contracts import BASE5, BASE8, base_spans, ids_of, plain_fingerprint, plain_repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER)
    return rows.dtypes, rows.collect()


def test_op1(spark, texts):
    kinds, rows = run(spark, "op1_pseudo_likelihood")
    assert kinds[:3] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("log_prob", "double")]
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r.log_prob < 0 if r.n_tokens else r.log_prob == 0 for r in rows)


def test_op2(spark, texts):
    kinds, rows = run(spark, "op2_toxicity")
    assert kinds == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op3(spark, texts):
    kinds, rows = run(spark, "op3_token_files")
    assert kinds == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    want, at = [], 0
    for i in sorted(texts):
        ids = ids_of(texts[i], "byte_bpe_50k.json", 0)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows)) == want


def test_op4(spark, texts):
    kinds, rows = run(spark, "op4_decontamination")
    assert [n for n, _ in kinds[:2]] == ["doc_id", "item_id"]
    found = {(r.doc_id, r.item_id) for r in rows}
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        passage = " ".join(item.text.split())
        assert {(i, item.item_id) for i, t in texts.items() if passage in " ".join((t or "").split())} <= found


@pytest.mark.parametrize("name, base", [("op5_pii", BASE5), ("op8_secrets", BASE8)])
def test_op5_and_op8(spark, texts, name, base):
    kinds, rows = run(spark, name)
    assert kinds[: len(base) + 3] == [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k, _, _ in base), ("base_sha256", "string"), ("spans", "string")]
    for r in rows:
        spans = base_spans(texts[r.doc_id], base)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _, _ in base] == [len(re.findall(rf"(?:^|,){k}:", spans)) for k, _, _ in base]
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))
    assert len(rows) == len(texts)


def test_op6(spark, texts):
    kinds, rows = run(spark, "op6_packing")
    assert kinds == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts.items():
        ids, at = ids_of(text, "word_bpe_49k.json", 2), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= 4096


def test_op7(spark, texts):
    kinds, rows = run(spark, "op7_simhash")
    assert kinds == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    for r in rows:
        group = {prints[r.doc_id]}
        while more := {p for p in prints.values() if p not in group and any((p ^ g).bit_count() <= 3 for g in group)}:
            group |= more
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == min(i for i, p in prints.items() if p in group)
    assert len(rows) == len(texts)


def test_op9(spark, texts):
    kinds, rows = run(spark, "op9_substrings")
    assert kinds == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    want = {}
    for row in map(eval, plain_repeats(list(texts.items()))):
        want[row[0]] = (row[1], row[2], hashlib.sha256(row[3].encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want


def test_op10(spark, texts):
    kinds, rows = run(spark, "op10_media")
    assert [n for n, _ in kinds[:8]] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    by_text = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > 33 and r.feature and by_text.setdefault(texts[r.doc_id] or "", tuple(r)[5:8]) == tuple(r)[5:8]
    assert len(rows) == len(texts)
