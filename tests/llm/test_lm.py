"""The language model against plain loops, and over whole corpora."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from strataq.llm import lm
from strataq.llm.terms import codes_of


def model(spark, docs, **sizes):
    rows = lm.coded(docs)
    counts = lm.word_counts(rows)
    return lm.fit_network(rows, counts, **sizes), counts


def test_each_word_tells_the_next(spark):
    rng = random.Random(9)
    order = list(range(60))
    rng.shuffle(order)
    walk = lambda a, n: " ".join(f"w{order[(a + j) % 60]}" for j in range(n))
    df = spark.createDataFrame([(i, walk(rng.randrange(60), 120)) for i in range(400)], "doc_id long, text string").repartition(2, "doc_id")
    shuffled = walk(0, 120).split()
    rng.shuffle(shuffled)
    test = spark.createDataFrame([(1, walk(5, 120)), (2, " ".join(shuffled)), (3, walk(7, 119) + " unseen"), (4, None), (None, " ")], "doc_id long, text string")
    scores = {r.doc_id: (r.n_tokens, r.log_prob) for r in lm.score_documents(test, df).collect()}
    unigram = 120 * math.log(1 / 60)
    assert scores[1][1] > unigram * 0.8 and scores[1][1] > scores[2][1] + 20 and scores[3][1] < scores[1][1]
    assert scores[4] == (0, 0.0) and scores[None] == (0, 0.0)
    assert lm.score_documents(test.limit(0)).count() == 0 and lm.score_documents(test.limit(0), df).count() == 0


def test_every_document_trains_the_network(spark):
    """Each of some one-document tables moves the network from its unigram start."""
    for i in range(3):
        docs = spark.createDataFrame([(i, " ".join(f"w{i} x{i} y{j % 3}" for j in range(50)))], "doc_id long, text string")
        assert np.abs(model(spark, docs)[0].classes).max() > 0


def plain_log_prob(net, counts, codes, head, known):
    """Log-probability of one text, token by token, from the network's arrays and the counts alone."""
    ranked = sorted(((c, n) for c, n in counts.items() if c in set(net.codes.tolist())), key=lambda x: (-x[1], x[0]))
    assert 0 < len(ranked) <= known and (len(ranked) == len(counts) or min(n for _, n in ranked) > max(n for c, n in counts.items() if c not in set(net.codes.tolist())))
    ids = {}
    for rank, (code, _) in enumerate(ranked):
        ids[code] = rank if rank < head else head + (rank - head) * lm.BANDS // (known - head)
    token = lambda c: ids.get(c, head + lm.BANDS + c % lm.HASHED)
    groups = Counter()
    for code, n in counts.items():
        groups[token(code)] += n
    total = 0.0
    for i, code in enumerate(codes):
        h = np.zeros(lm.DIM)
        for j, o in enumerate(lm.OFFSETS):
            other = token(codes[i + o]) if 0 <= i + o < len(codes) else lm.VOCAB
            h += net.embed[other] * net.place[j]
        h = np.tanh(h)
        group, member = divmod(token(code), lm.MEMBERS)
        a = [math.exp(net.classes[k] @ h + net.class_bias[k]) for k in range(lm.CLASSES)]
        b = [math.exp(net.members[group][k] @ h + net.member_bias[group][k]) for k in range(lm.MEMBERS)]
        total += math.log(a[group] / sum(a)) + math.log(b[member] / sum(b)) + math.log(counts[code] / groups[token(code)])
    return total


def test_log_probs_against_plain_loops(spark):
    """With few known words, so that some are in bands and some in the joined table."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net, counts = model(spark, docs, head=40, known=70)
    known = {r.code: r.n for r in counts.collect()}
    assert len(known) > 100
    scores = {r.doc_id: r.log_prob for r in lm.score_coded(lm.coded(docs), net, counts).collect()}
    for i, text in rows:
        assert abs(scores[i] - plain_log_prob(net, known, codes_of(pa.array([text]))[0].tolist(), 40, 70)) < 0.02


def test_log_probs_sum_to_one():
    net = lm.start_network(np.arange(10, dtype=np.int64), np.arange(10, 0, -1), np.ones(lm.HASHED))
    rng = np.random.default_rng(0)
    net.members += rng.normal(0, 0.5, net.members.shape).astype(np.float32)
    net.classes += rng.normal(0, 0.5, net.classes.shape).astype(np.float32)
    context = np.tile(rng.integers(0, lm.VOCAB, len(lm.OFFSETS)), (lm.VOCAB, 1))
    assert abs(np.exp(net.log_probs(context, np.arange(lm.VOCAB)).astype(np.float64)).sum() - 1) < 1e-3
