"""Decontamination: passages of any length, paraphrases, and recall against exhaustive search."""

import random

import numpy as np
import pyarrow as pa

from strataq.llm import decontaminate
from strataq.llm.terms import codes_of


def words(rng, n, prefix="t", kinds=3000):
    return [f"{prefix}{rng.randrange(kinds)}" for _ in range(n)]


def found(spark, docs, items):
    rows = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return rows.collect()


def test_passages_of_any_length(spark):
    rng = random.Random(2)
    sizes = [1, 2, 5, 7, 8, 20, 60, 65, 120, 200, 256, 300, 400, 800]
    items = [(n, " ".join(words(rng, n, f"p{n}x"))) for n in sizes] + [(i + 1000, " ".join(words(rng, 40, "q"))) for i in range(60)]
    docs = [(i, " ".join([*words(rng, rng.randrange(300)), *items[i][1].split(), *words(rng, rng.randrange(300))])) for i in range(len(sizes))]
    docs += [(100 + i, " ".join(words(rng, 400))) for i in range(40)]
    got = {(r.doc_id, r.item_id) for r in found(spark, docs, items)}
    assert got == {(i, n) for i, n in enumerate(sizes)}


def test_null_and_repeated_items(spark):
    rng = random.Random(3)
    a, b = " ".join(words(rng, 30, "a")), " ".join(words(rng, 6, "b"))
    docs = [(1, f"x {a} y"), (2, f"x {b} y"), (None, f"{a} {b}"), (3, None), (4, "")]
    rows = found(spark, docs, [(None, a), (7, a), (7, a), (None, b), (8, None), (9, ""), (10, "...")])
    assert sorted((str(r.doc_id), str(r.item_id)) for r in rows) == sorted([("1", "None"), ("1", "7"), ("1", "7"), ("2", "None"), ("None", "None"), ("None", "7"), ("None", "7"), ("None", "None")])


def unit(codes, idf):
    terms, weights = decontaminate._row_of(np.array(codes), idf)
    out = np.zeros(decontaminate.TERMS)
    out[terms] = weights
    return out


def test_latent_space_finds_what_tfidf_cosine_misses(spark):
    """A paraphrase keeps the common words and the answer, and has other rare words of the same topic."""
    rng = random.Random(4)
    topics = [[f"topic{k}w{i}" for i in range(12)] for k in range(6)]
    common = [f"c{i}" for i in range(60)]

    def passage(topic, base, rare):
        out = list(base)
        for at, word in zip(range(1, len(out) - 6, 3), rare):
            out[at] = word
        return out

    items, docs = [], []
    for i in range(60):
        topic, base = topics[i % 6], words(rng, 40, "c", 60)
        mixed = rng.sample(topic, 11)
        items.append((i, " ".join(passage(topic, base, mixed))))
        other = [w for w in rng.sample(topic, 12)][:11]
        docs.append((i, " ".join(passage(topic, base, [o if o != m else topic[(topic.index(m) + 1) % 12] for o, m in zip(other, mixed)]))))
    filler = [(1000 + i, " ".join(rng.choice(common) for _ in range(80))) for i in range(400)]
    frequencies, n = decontaminate.document_frequencies(spark.createDataFrame(docs + filler, "doc_id long, text string"))
    idf = decontaminate.idf_of(frequencies, n)
    got = {(r.doc_id, r.item_id) for r in found(spark, docs + filler, items)}
    assert sum((i, i) in got for i in range(60)) >= 54
    space = decontaminate.fit_space(spark.createDataFrame(items, "item_id long, text string"), idf)
    assert space.vectors.shape[1] == 20  # a third of the passages
    # Words of one topic that never replace each other in a text are close in the space all the same.
    lone = [f"c1 c2 c3 c4 c5 c6 c7 c8 {' '.join(topics[0][:6])}", f"c11 c12 c13 c14 c15 c16 c17 c18 {' '.join(topics[0][6:])}"]
    x, y = (codes_of(pa.array([t]))[0] for t in lone)
    latent = space.place(x) @ space.place(y) / np.linalg.norm(space.place(x)) / np.linalg.norm(space.place(y))
    assert float(unit(x, idf) @ unit(y, idf)) < 0.1 and latent > 0.5


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_recall_against_exhaustive_search(spark):
    """Every passage against every window of every document, by a plain table of the subsequence."""
    rng = random.Random(6)
    items = [(i, words(rng, rng.choice([6, 15, 30, 50, 90]), "t", 900)) for i in range(30)]
    docs = []
    for d in range(50):
        text = words(rng, rng.randrange(0, 120), "t", 900)
        if d % 2:
            own = [w for w in items[rng.randrange(30)][1] if rng.random() > 0.12 * (d % 3)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((d, text))
    want = set()
    for d, text in docs:
        for i, item in items:
            share = max(plain_lcs(item, text[a : a + 2 * len(item)]) for a in range(0, max(1, len(text) - len(item)), max(1, len(item) // 4))) / len(item)
            said = any(text[a : a + 5] == item[-5:] for a in range(len(text) - 4))
            if len(item) < decontaminate.MIN_WORDS:
                hit = any(text[a : a + len(item)] == item for a in range(len(text)))
            else:
                hit = share >= 0.8 or share >= 0.6 and said
            if hit:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in found(spark, [(d, " ".join(t)) for d, t in docs], [(i, " ".join(t)) for i, t in items])}
    assert len(want) >= 15 and got <= want and len(got) >= 0.9 * len(want)
