"""Near-duplicates by SimHash fingerprints within a Hamming distance, found by vantage-point trees.

Fingerprints of equal texts meet in one class first. A vantage-point tree, fitted on a bounded sample
of classes, deals all classes to shards by Hamming distance: at each node a class goes inside or
outside a ball; if the triangle bound says that a partner may lie across the border, a class inside
also visits the outside. By induction every linked pair meets in some shard. Where a leaf of the fitted
tree gets more than SHARD classes (counted first), it goes on below by vantage points drawn from a
hash of the place in the tree: first as deep as its count asks, then, part by part, wherever a counted
part still holds over twice SHARD, until none does or none shrinks (fingerprints nearer each other than
any ball can part). These points need no sample, and only the parts that are too large are told to the
driver. A shard's task splits on by vantage points of its own down to small leaves, compares there, and
emits one edge per class to the smallest of its local group, never all pairs. Components of these edges
are the result.

Nulls, empty and long texts: a null text is an empty one, with fingerprint zero; long texts are hashed
whole. Repeated rows get equal fingerprints and component; a null doc_id is never the smallest (the
component of a group without any other id is null). An empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import materialize, slices

SHINGLE, BITS, RADIUS = 3, 64, 3
#: Classes that the tree is fitted on, at most; classes wanted in a shard; classes compared in a leaf.
SAMPLE, SHARD, LEAF = 32_768, 16_384, 2048
#: Leaves of the fitted tree at most.
LEAVES = SAMPLE // 16
#: Radius that leaves a drawn ball's inside and outside (with its visitors) alike, and the share of either.
BALANCED, KEEPS = BITS // 2 + 1, 0.65
#: Levels below a fitted leaf at most (a part's number has 63 bits), and rounds of counting.
DEEPEST, ROUNDS = 60, 8
#: Shingles hashed at once.
CHUNK = 1 << 17


def fingerprint(text: str | None) -> int:
    """Bits set in over half the XXH64 hashes (seed 42) of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    size = min(SHINGLE, len(words))
    starts = np.concatenate(([0], gaps + 1))[: len(words) - size + 1].tolist()
    ends = np.concatenate((gaps, [len(whole)]))[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        raw = b"".join([digest(whole[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def _distance(x: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ point)


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius of its ball; None if no point splits x well."""
    best = None
    for point in x[rng.integers(0, len(x), 4)]:
        d = np.bincount(_distance(x, point), minlength=BITS + 1)
        inside = np.cumsum(d)
        # What the larger side holds, with those that visit the outside.
        larger = np.maximum(inside, len(x) - inside + np.array([d[max(0, r - RADIUS + 1) : r + 1].sum() for r in range(BITS + 1)]))
        r = int(np.argmin(larger))
        if best is None or larger[r] < best[0]:
            best = (larger[r], point, r)
    return (best[1], best[2]) if best and best[0] < 0.9 * len(x) else None


def _parts(x: np.ndarray, point: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of what goes inside, and outside: there also what is inside by less than RADIUS."""
    d = _distance(x, point)
    return d <= radius, d > radius - RADIUS


def fit_tree(sample: np.ndarray, leaves: int) -> list[tuple[np.uint64, int, int, int]]:
    """Nodes (point, radius, child inside, child outside); a child below 0 is shard -child - 1."""
    nodes: list[tuple[np.uint64, int, int, int]] = []
    rng, shards = np.random.default_rng(7), 0

    def grow(x: np.ndarray, wanted: int) -> int:
        nonlocal shards
        cut = _split(x, rng) if wanted > 1 and len(x) > 16 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append((*cut, 0, 0))
        inside, outside = _parts(x, *cut)
        nodes[at] = (*cut, grow(x[inside], wanted // 2), grow(x[outside], wanted - wanted // 2))
        return at

    grow(sample, leaves)
    return nodes


def route(x: np.ndarray, nodes: list[tuple[np.uint64, int, int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, members) of all shards that some of x go to or visit."""
    todo = [(0 if nodes else -1, x)]
    while todo:
        at, members = todo.pop()
        if not len(members):
            continue
        if at < 0:
            yield -at - 1, members
            continue
        point, radius, a, b = nodes[at]
        inside, outside = _parts(members, point, radius)
        todo += [(a, members[inside]), (b, members[outside])]


def depth_for(n: int) -> int:
    """Levels of drawn vantage points for n classes: a balanced ball leaves KEEPS of them on either side."""
    return math.ceil(math.log(n / SHARD, 1 / KEEPS)) if n > SHARD else 0


def deepen(x: np.ndarray, shard: int, depth: int, further: dict[int, int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(part, members): a leaf's members dealt on by depth levels of drawn vantage points, and where a part's
    number is in further, by so many levels more. A part's number is the path to it, after a leading 1."""
    todo = [(1, x, depth)]
    while todo:
        at, members, left = todo.pop()
        if not len(members):
            continue
        if not left:
            left = (further or {}).get(at, 0)
            if not left:
                yield at, members
                continue
        point = np.uint64(xxhash.xxh64_intdigest(f"{shard}:{at}"))
        inside, outside = _parts(members, point, BALANCED)
        todo += [(2 * at, members[inside], left - 1), (2 * at + 1, members[outside], left - 1)]


def local_groups(x: np.ndarray) -> np.ndarray:
    """The index of the first of each member's group, of distinct fingerprints linked within this shard."""
    label = np.arange(len(x))
    rng = np.random.default_rng(11)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return int(i)

    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        cut = _split(x[own], rng) if len(own) > LEAF else None
        if cut is not None:
            inside, outside = _parts(x[own], *cut)
            todo += [own[inside], own[outside]]
            continue
        values = x[own]
        for at in range(0, len(own), 256):
            near = np.bitwise_count(values[at : at + 256, None] ^ values[None, at:]) <= RADIUS
            a, b = np.nonzero(near)
            a, b = label[own[at + a]], label[own[at + b]]
            apart = a != b
            for i, j in np.unique(np.stack((a[apart], b[apart]), 1), axis=0).tolist():
                i, j = root(i), root(j)
                label[max(i, j)] = min(i, j)
            while True:  # flatten
                flat = label[label]
                if (flat == label).all():
                    break
                label[:] = flat
    return label


def links(classes: DataFrame) -> DataFrame:
    """(src, dst): edges that connect exactly the fingerprints linked by distances within RADIUS."""
    n = classes.count()
    sample = classes.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).toPandas()
    nodes = fit_tree(sample["fingerprint"].to_numpy(np.int64).view(np.uint64), min(LEAVES, -(-n // SHARD))) if n else []

    depths: dict[int, int] = {}
    further: dict[int, dict[int, int]] = {}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, members in route(x, nodes):
                for part, own in deepen(members, shard, depths.get(shard, 0), further.get(shard)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(np.full(len(own), part)), pa.array(own.view(np.int64))], names=["shard", "part", "fingerprint"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            for shard, members in route(batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64), nodes):
                for part, own in deepen(members, shard, depths.get(shard, 0), further.get(shard)):
                    found[shard, part] = found.get((shard, part), 0) + len(own)
        columns = ([k[0] for k in found], [k[1] for k in found], list(found.values()))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["shard", "part", "n"])

    def large() -> dict[tuple[int, int], int]:
        """The parts over twice SHARD, with their size."""
        sizes = classes.select("fingerprint").mapInArrow(tally, "shard int, part long, n long").groupBy("shard", "part").agg(F.sum("n").alias("n"))
        return {(r["shard"], r["part"]): r["n"] for r in sizes.filter(F.col("n") > 2 * SHARD).collect()}

    if n > LEAVES * SHARD:  # the fitted tree alone keeps shards small below that
        now = large()
        depths = {shard: min(DEEPEST, depth_for(size)) for (shard, _), size in now.items()}
        stuck: set[tuple[int, int]] = set()
        for _ in range(ROUNDS):
            before, now = now, {k: v for k, v in large().items() if k not in stuck}
            for (shard, part), size in now.items():
                above = next((before[shard, part >> up] for up in range(1, DEEPEST) if (shard, part >> up) in before), None)
                if part.bit_length() > DEEPEST or (above is not None and size > 0.95 * above):
                    stuck.add((shard, part))
                else:
                    further.setdefault(shard, {})[part] = max(1, min(depth_for(size), DEEPEST + 1 - part.bit_length()))
            now = {k: v for k, v in now.items() if k not in stuck}
            if not now:
                break

    def compare(shard: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(shard["fingerprint"].to_numpy(np.int64).view(np.uint64))
        label = local_groups(x)
        moved = label != np.arange(len(x))
        return pd.DataFrame({"src": x[moved].view(np.int64), "dst": x[label[moved]].view(np.int64)})

    return classes.select("fingerprint").mapInArrow(deal, "shard int, part long, fingerprint long").groupBy("shard", "part").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    labels = connected_components(links(classes)).select(F.col("node").alias("fingerprint"), "component")
    placed = classes.join(labels, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    # Written first, so that both sides of the last join are plain shuffles and a hot class is split.
    ids = materialize(placed.join(least, "component").select("fingerprint", "component_id"), "fingerprint-components")
    return rows.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one of its smallest id. Rows without an id are kept, as they
    cannot be told apart; of repeated rows of that id, one stays."""
    first = near_duplicates(docs, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    rows = docs.join(first, F.col(f"`{id_col}`").cast("long") == F.col("__kept"), "left_semi")
    # The join has dealt rows by id already; rows of one id are few.
    nth = F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`")).orderBy(F.col(f"`{text_col}`")))
    one = rows.withColumn("__nth", nth).filter("__nth = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
    return one.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
