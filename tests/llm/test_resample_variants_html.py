"""Resampling, spelling variants and page text against plain versions, with every odd case."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataq.llm import bytewords, html_text, queries, resample, variants
from strataq.llm.automaton import Automaton, Words, near_words

from .test_contracts import DOCS, SCHEMA

FOLDER = "/root/testdata/sf0.001"
NOISE = [(20, "Straße ÄRGER ×÷ é9 x1-y2 a_b " * 6), (21, "w " * 19), (22, "w " * 20), (23, "\x00a\x7fb c " * 9), (24, "z" * 40_000 + " " + "z" * 40_000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", len(t or ""), "f", "s", "k", "st", "p") for i, t in DOCS + NOISE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "text")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_features(text, n=2):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_draw(rows, target, least=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x)) for texts in ([x for _, x in rows], target))
    every, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        found = [math.floor(1000 * math.log((t[b] + 1) * (every + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, plain_features(text))]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(plain_words(text)) >= least])
    enough = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = k
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_buckets_by_suffix_array(n):
    texts = [t for _, t in DOCS + NOISE]
    found, ends, count = resample.buckets_of(pa.array(texts, pa.string()), n, 10_000)
    for i, t in enumerate(texts):
        assert count[i] == len(plain_words(t))
        assert found[ends[i] : ends[i + 1]].tolist() == [zlib.crc32(f.encode()) % 10_000 for f in plain_features(t, n)]


def test_joined_crc():
    rng = random.Random(3)
    parts = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice([0, 1, 2, 7, 300, 70_000]))) for _ in range(60)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = bytewords.joined_crc(crc(a for a, _ in parts), crc(b for _, b in parts), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_resample(spark, docs):
    target = ["the quick brown fox of a b", None, "w w w straße"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, table).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = plain_draw(DOCS + NOISE, target)
    ranked = lambda rows: sorted(tuple(r)[:4] for r in rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((tuple(r[:4]) for r in want), key=key)
    drawn = lambda rows: sorted((r[4], r[3]) for r in rows if r[4] is not None)
    assert drawn(got) == drawn(want) and drawn(got)
    empty = docs.limit(0)
    assert resample.resample(empty, table).count() == 0
    assert resample.resample(docs, table.limit(0)).count() == len(DOCS + NOISE)
    with pytest.raises(ValueError):
        resample.code_features(docs, "doc_id", buckets=70_000)


def test_op11_equals_plain(spark):
    rows = queries.QUERIES["op11_resampling"](spark, FOLDER)
    assert rows.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert sorted(map(tuple, rows.collect())) == sorted(tuple(r[:5]) for r in plain_draw(texts, target))


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=7, min_count=2, ratio=10, damage=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run
            count[run] += len(run) >= least
    count = {w: n for w, n in count.items() if n >= min_count}
    by_gap = {}
    for w in count:
        for i in range(len(w)):
            by_gap.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    out = {}
    for w, n in count.items():
        close = {v for i in range(len(w)) for v in by_gap.get(w[:i] + w[i + 1 :], ())} | by_gap.get(w, set()) | {w[:i] + w[i + 1 :] for i in range(len(w))}
        near = [v for v in close if v in count and one_edit(v, w)] if len(w) < 1000 else [v for v in count if one_edit(v, w)]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        form = best if best is not None and count[best] >= ratio * n else None
        out[w] = [n, len(near), form, count[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize("seed", range(8))
def test_automaton_and_near_words(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choices(b"ab\xe9", k=rng.randint(1, 9))) for _ in range(rng.choice([1, 5, 300]))})
    own = Words(words)
    automaton = Automaton(own)
    for i, w in enumerate(words):  # a word's number is its place
        state, number = automaton.start, 0
        for byte in w:
            edge = automaton.step(np.array([state]), np.array([byte]))[0]
            state, number = automaton.target[edge], number + automaton.skip[edge]
        assert automaton.final[state] and number == i
    endings = {}  # minimal: no two states have the same endings
    for s in range(len(automaton.final) - 1, -1, -1):
        edges = range(automaton.first[s], automaton.first[s + 1])
        signature = (bool(automaton.final[s]), tuple((int(automaton.byte[e]), int(automaton.target[e])) for e in edges))
        assert endings.setdefault(signature, s) == s
    query, near = near_words(automaton, own, own.size // 2)
    want = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if b[: len(a) // 2] == a[: len(a) // 2] and one_edit(a, b)]
    assert list(zip(query.tolist(), near.tolist())) == want


def test_spelling_variants(spark, docs):
    rng = random.Random(5)
    base = ["straßenbahn", "éléphants", "letters", "lettering", "window", "windows", "aaaaaaa", "abababa"]
    def bent(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "é" + w[i:], w[:i] + "Q" + w[i + 1 :]])
    texts = [(100 + i, " ".join([*rng.choices(base, [60, 30, 9, 8, 40, 3, 2, 2], k=400), *(bent(w) for w in rng.choices(base, k=60))])) for i in range(6)]
    more = spark.createDataFrame(texts + [(100, texts[0][1])], "doc_id long, text string")
    every = docs.unionByName(more, allowMissingColumns=True)
    got = variants.spelling_variants(every)
    want = plain_variants(DOCS + NOISE + texts + texts[:1])
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == want
    assert any(w[4] != w[2] for w in want.values() if w[2]) or any(w[2] for w in want.values())
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_op12_equals_plain(spark):
    rows = queries.QUERIES["op12_variants"](spark, FOLDER)
    assert rows.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows.collect()} == plain_variants(texts)


GOOD = "The cat sat on the mat and it was not a dog that was in the house with the man. " * 4
NEXT = "It was the best of times and it was the worst of times for all of them in the city. " * 3
TALK = "I think that the author is right and it was a good text for all of us to read here. " * 3
LINES = "\n".join


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>Just this.</p>", "Just this."),
        ("<script>var a = '<p>no</p>'", ""),
        ("<p>1 &lt; 2 &amp;amp; a<b>b</b>c &#8364;&nbsp;x<br>y <3 z</p>", "1 < 2 &amp; abc € x y <3 z"),
        (f"<nav><p>{TALK}</p></nav><article><h1>Short title</h1><p>{GOOD}</p><p>End.</p></article><footer>&copy; 2020 Me</footer>", LINES(["Short title", GOOD.strip(), "End."])),
        (f"<div id=menu><a href=1>Home</a></div><div class=content><h1>A title</h1><p>{GOOD}<p>Short one.<p>{NEXT}</div><div class=x><h3>3 Comments</h3><p>{TALK}</p></div>", LINES(["A title", GOOD.strip(), "Short one.", NEXT.strip()])),
        (f"<div class='cookie-notice'><p>{TALK}</p></div><main><p>Hi there.</p><section class=comments><article class=comment><p>{TALK}</p></article></section></main>", "Hi there."),
        (f"<body class=has-sidebar><form><article><p>{GOOD}</p></article></form><div role=complementary>{TALK}</div><aside>{TALK}</aside></body>", GOOD.strip()),
        (f"<article><p>{GOOD}</p><div class=advert><p>{TALK}</p></div><p>Qzx vbn kjh wqe rty uio pas dfg hjk lzx cvb nmq wer tyu iop asd fgh jkl zxc.</p></article>", LINES([GOOD.strip(), "Qzx vbn kjh wqe rty uio pas dfg hjk lzx cvb nmq wer tyu iop asd fgh jkl zxc."])),
        (f"<p>{GOOD}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>{NEXT}</p>", LINES([GOOD.strip(), NEXT.strip()])),
        ("<b>" * 3000 + "deep" + "</i></div>" * 3000, "deep"),
        ("<!-- <p>no</p> --><!DOCTYPE html><![CDATA[x]]><p title='a > b'>yes</p", "yes"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def plain_article(page):
    """The generated pages hold their text in one article element of plain tags."""
    inner = re.sub("</?(?:p|h1|br)>", "\n", page[page.index("<article>") + 9 : page.index("</article>")])
    lines = (" ".join(html.unescape(x).split()) for x in re.sub("<[^>]*>", "", inner).split("\n"))
    return "\n".join(x for x in lines if x)


def test_op13_equals_articles(spark):
    rows = queries.QUERIES["op13_html"](spark, FOLDER)
    assert rows.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = rows.collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


def test_extract_text_odd_tables(spark):
    rows = [(1, "u", None, "old", "c"), (1, "u", None, "old", "c"), (None, None, f"<p>{GOOD}</p>", None, None), (2, "u", "<p>" + "word " * 200_000, "x", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `__html` string")
    got = html_text.extract_text(pages.drop("__html"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, len(GOOD.strip())), (1, 0), (1, 0), (2, 999_999)]
    assert html_text.extract_text(pages.select("html").limit(0)).count() == 0
