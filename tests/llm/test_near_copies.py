"""Near copies against all pairs compared by their shingle sets."""

import random

import numpy as np
import pyarrow as pa

from strataq.llm import near_copies


def plain_kept(rows):
    """(id, text) that stay of each group, all pairs compared."""
    sets = [near_copies.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and near_copies.jaccard(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            groups.setdefault(root(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values()) + [None] * sum(i is None for i, _ in rows)


def test_copies_of_similarity_over_threshold_go(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        base = [f"W{rng.randrange(5000)}" for _ in range(rng.randrange(3, 300))]
        for _ in range(rng.randrange(1, 5)):
            own = base[:]
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(None, rows[0][1]), (7, "one text of id seven alone"), (7, "other words that share nothing with it"), (900, ""), (901, None), (902, " \n")]
    rng.shuffle(rows)
    got = [r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    want = plain_kept(rows)
    assert len(want) < len(rows) - 20
    assert sorted(i for i in got if i is not None) == [i for i in want if i is not None] and got.count(None) == want.count(None)


def test_links_that_the_fingerprint_radius_misses(spark):
    """A copy with a changed word in fifty is over 0.8, though op7's fingerprints may differ by over 3 bits."""
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"v{rng.randrange(9000)}" for _ in range(100)]
        rows.append((2 * i, " ".join(words)))
        words[50] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_sketches_of_equal_sets_are_equal():
    kinds, keys = near_copies.sketches(pa.array(["A b c d e f", "a  B c\nd e f", None, "", "a b", "a b c d e f a b c d e f"]))
    assert kinds[0] == kinds[1] != kinds[4] and kinds[2] == kinds[3] == 0 and (keys[0] == keys[1]).all() and kinds[5] != kinds[0]


def test_large_group_in_blocks(spark, monkeypatch):
    """Copies with so many changes that few pairs of the group are linked."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(5)
    base, rows = [f"b{rng.randrange(9000)}" for _ in range(120)], []
    for i in range(150):
        own = base[:]
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(own)))
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_joining_links_join_what_is_similar():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(8)) for _ in range(80)] + ["", None, "a b"]
    sets = [near_copies.shingles(t) for t in texts]
    component = np.array([rng.randrange(60) for _ in texts])
    label = component.copy()
    for i, j in near_copies.joining_links(pa.array(texts), component, 0.5):
        assert near_copies.jaccard(sets[i], sets[j]) >= 0.5 and label[i] != label[j]
        label[label == label[j]] = label[i]
    for i in range(len(texts)):
        for j in range(i):
            assert label[i] == label[j] or not sets[i] or not sets[j] or near_copies.jaccard(sets[i], sets[j]) < 0.5


def test_the_tree_of_fingerprints_gives_candidates(spark, monkeypatch):
    """Classes whose fingerprints lie within the radius, all pairs compared, are joined by the tree's pairs; with them
    alone, copies of one changed word in two thousand go."""
    rng = random.Random(9)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(9000)}" for _ in range(2000)]
        texts.append(" ".join(words))
        words[rng.randrange(2000)] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, "a b"]
    kinds, keys, prints = near_copies.sketches_and_fingerprints(pa.array(texts))
    apart = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64))
    label = {int(k): int(k) for k in kinds}
    pairs = [(r.a, r.b) for r in near_copies.tree_pairs(spark.createDataFrame(list(zip(kinds.tolist(), prints.tolist())), "class long, fingerprint long")).collect()]
    for a, b in pairs:
        old, new = label[b], label[a]
        label = {k: new if v == old else v for k, v in label.items()}
    near = [(i, j) for i in range(len(texts)) for j in range(i) if apart[i, j] <= 3 and texts[i] and texts[j]]
    assert len(near) > 15 and all(label[int(kinds[i])] == label[int(kinds[j])] for i, j in near)

    def no_bands(arrow, size=near_copies.SHINGLE):
        kinds, keys, prints = real(arrow, size)
        return kinds, np.arange(keys.size).reshape(keys.shape) + kinds[:, None], prints

    real = near_copies.sketches_and_fingerprints
    monkeypatch.setattr(near_copies, "sketches_and_fingerprints", no_bands)
    rows = list(enumerate(texts[:60]))
    kept = {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 60 - len(kept) > 15 and {i for i in range(0, 60, 2)} <= kept
