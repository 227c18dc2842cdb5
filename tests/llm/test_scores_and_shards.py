"""The factorisation machine's score as a double loop over pairs, and the size of vantage-point shards."""

import math
import string

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strataq.llm import simhash, toxicity


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(8)
    vocabulary = ["you", "they", "fool", "group", "hate", "fine", "élan", "x1"]
    code = {w: xxhash.xxh32_intdigest(w.encode()) for w in vocabulary}
    terms = np.array(sorted(code.values()), np.int64)
    machine = toxicity.Machine(-0.3, terms, rng.normal(size=8), rng.normal(size=(8, toxicity.FACTORS)))
    texts = ["You fool, you!", "they HATE the group", None, "", "?!", "unknown words only", "fine fine fine élan. (x1) group", " ".join(vocabulary * 30)]
    got = machine.score(pa.array(texts, pa.string()))
    for text, score in zip(texts, got):
        own = sorted({xxhash.xxh32_intdigest(w.encode()) for w in (x.strip(string.punctuation).lower() for x in (text or "").split()) if w} & set(code.values()))
        at = [terms.tolist().index(c) for c in own]
        logit = machine.bias + sum(machine.weights[i] for i in at)
        for n, i in enumerate(at):
            for j in at[n + 1 :]:
                logit += sum(float(a) * float(b) for a, b in zip(machine.factors[i], machine.factors[j]))
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-12)


@pytest.mark.parametrize("times", [4, 64, 256])
def test_parts_stay_within_twice_the_wanted_size(times, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 256)
    rng = np.random.default_rng(times)
    x = np.unique(rng.integers(0, 1 << 63, times * 256, np.uint64) * np.uint64(2) + rng.integers(0, 2, times * 256).astype(np.uint64))
    depth = simhash.depth_for(len(x))
    further: dict[int, int] = {}
    for _ in range(simhash.ROUNDS):  # as links() does by counts
        large = {part: len(own) for part, own in simhash.deepen(x, 5, depth, further) if len(own) > 2 * 256}
        if not large:
            break
        further |= {part: max(1, simhash.depth_for(n)) for part, n in large.items()}
    parts = dict(simhash.deepen(x, 5, depth, further))
    assert max(map(len, parts.values())) <= 2 * 256
    near = x[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))  # each must meet its partner somewhere
    both = np.concatenate((x, near))
    met = np.zeros(200, bool)
    for _, own in simhash.deepen(both, 5, depth, further):
        met |= np.isin(x[:200], own) & np.isin(near, own)
    assert met.all()
