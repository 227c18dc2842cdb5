"""Near copies of texts: SimHash fingerprints in a vantage-point tree, confirmed by the exact Jaccard similarity
of word shingles, with MinHash bands for the links beyond the tree's radius.

Rows with equal sets of SHINGLE-word shingles form a class, and each class has a SimHash fingerprint of its
shingles. Fingerprints within simhash.RADIUS bits are found by op7's vantage-point tree (simhash.links), and each
class is compared with the least of its fingerprint, and that with the least of the tree's group. A ball wide
enough for a similarity of 0.8 spans a quarter of all bits, where no tree prunes, so the links that lie
farther apart come from bands: a class's MinHash values are cut into BANDS bands of ROWS, and classes that share
a band meet in a bucket: a pair of similarity 0.8 shares none with probability (1 - 0.8 ** ROWS) ** BANDS, below
one in a million, and a nearer pair more rarely. All links are confirmed on the words themselves. First each class
of a bucket is compared with the bucket's least. Buckets that are in several components after that and the
tree's links are compared whole, inside tasks: in blocks of BLOCK classes, each pair of blocks
in one task, which counts shared shingles through lists of their holders and sends on no more links than join
the components. So no pair is a row, and no task holds more than two blocks. Components of the links are groups.

Nulls, empty and long texts: a null text is an empty one, and texts without words are one class; a text of
fewer words is one shingle; long texts are taken whole. Rows without an id are kept. Of a group, the row of
the smallest id stays, one if that id is repeated; rows of one id in different groups each count for theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators.graph import connected_components
from . import simhash
from .common import materialize, ranges, slices
from .substrings import words_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 48, 6
_RNG = np.random.default_rng(17)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Shingles whose MinHash values are taken at once: small enough for the cache.
CHUNK = 1 << 15
#: Classes of a bucket that are compared at once.
BLOCK = 512


def shingles(text: str | None, size: int = SHINGLE) -> frozenset[bytes]:
    """The word shingles of a text, in small letters; of bytes: A-Z and ASCII white space only."""
    words = (text or "").encode("utf-8").lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hash) of the distinct shingles of some texts, in order, and the number of texts."""
    words, borders = words_of(texts)
    coded = words.dictionary_encode()
    raw = pc.ascii_lower(coded.dictionary).cast(pa.large_binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    codes = table[coded.indices.to_numpy(zero_copy_only=False)]
    lengths = np.diff(borders)
    counts = np.where(lengths > 0, np.maximum(lengths - size + 1, 1), 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.repeat(borders[:-1] - np.cumsum(counts) + counts, counts) + np.arange(len(text))
    left = np.repeat(borders[1:], counts) - first  # words up to the text's end
    found = np.zeros(len(text), np.uint64)
    for j in range(size):
        own = codes[np.minimum(first + j, max(len(codes) - 1, 0))]
        found = np.where(left > j, _mixed(found * np.uint64(0x9E3779B97F4A7C15) + own), found)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    if len(text):
        new = np.append(True, (text[1:] != text[:-1]) | (found[1:] != found[:-1]))
        text, found = text[new], found[new]
    return text, found, len(lengths)


def sketches(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(class, BANDS keys) of each text; texts without words are class 0 and have keys 0."""
    return sketches_and_fingerprints(texts, size)[:2]


def sketches_and_fingerprints(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, BANDS keys, fingerprint) of each text; a fingerprint has the bits that are set in over half of the
    hashes of its distinct shingles, and is 0 without words."""
    text, found, n = hashed_shingles(texts, size)
    ends = np.searchsorted(text, np.arange(n + 1))
    kinds, keys = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(ends))
    kinds[full] = [xxhash.xxh3_64_intdigest(found[ends[i] : ends[i + 1]].tobytes()) for i in full]
    least, prints = np.empty((BANDS * ROWS, len(full)), np.uint64), np.zeros(n, np.uint64)
    at = 0
    while at < len(full):  # texts of about CHUNK shingles together
        to = max(at + 1, int(np.searchsorted(ends[full], ends[full[at]] + CHUNK)))
        a, b = ends[full[at]], ends[full[to - 1] + 1]
        own, starts = found[a:b], ends[full[at:to]] - a
        for k in range(BANDS * ROWS):
            least[k, at:to] = np.minimum.reduceat((own ^ SHIFTS[k]) * FACTORS[k], starts)
        sizes = np.diff(starts, append=len(own))
        for bit in range(simhash.BITS):
            held = np.add.reduceat((own >> np.uint64(bit) & np.uint64(1)).astype(np.int32), starts)
            prints[full[at:to]] |= (2 * held > sizes).astype(np.uint64) << np.uint64(bit)
        at = to
    for band in range(BANDS):
        key = np.full(len(full), band + 1, np.uint64)
        for row in least[band * ROWS : (band + 1) * ROWS]:
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[full, band] = key
    return kinds.view(np.int64), keys.view(np.int64), prints.view(np.int64)


def _sketched(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with a number of their own (__row), class, fingerprint and band keys, written."""
    at = docs.columns.index(text_col)
    names = [*docs.columns, "__row", "__class", "__fingerprint", "__keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, at):
            n = batch.num_rows
            kinds, keys, prints = sketches_and_fingerprints(batch.column(at).cast(pa.string()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(row, row + n)), pa.array(kinds), pa.array(prints), lists], names=names)
            row += n

    schema = StructType([*docs.schema.fields, StructField("__row", LongType()), StructField("__class", LongType()), StructField("__fingerprint", LongType()), StructField("__keys", ArrayType(LongType()))])
    return materialize(docs.mapInArrow(run, schema), "sketches")


def tree_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): classes (class, fingerprint) to compare, as few as join what the vantage-point tree links: each with the
    least of its fingerprint, and the leasts of fingerprints that the tree links; written."""
    order = F.struct(F.xxhash64("class").alias("order"), "class")
    found = classes.filter("class <> 0").select("class", "fingerprint")
    prints = materialize(found.groupBy("fingerprint").agg(F.min(order)["class"].alias("least")), "near-fingerprints")
    equal = found.join(prints, "fingerprint").filter("class <> least").select(F.col("least").alias("a"), F.col("class").alias("b"))
    end = lambda old, new: prints.select(F.col("fingerprint").alias(old), F.col("least").alias(new))
    near = simhash.links(prints).join(end("dst", "a"), "dst").join(end("src", "b"), "src").select("a", "b")
    return materialize(equal.unionByName(near), "tree-pairs")


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts are so similar, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, frozenset()
        for batch in slices(batches, "y"):
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            kept = []
            for i in range(len(a)):
                if a[i] != last:
                    last, own = a[i], shingles(x[i])
                kept.append(jaccard(own, shingles(y[i])) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    rows = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("class").alias("a"), F.col("text").alias("x")), "a")
    return materialize(rows.select("a", "b", "x", "y").mapInArrow(run, "src long, dst long"), "confirmed")


def joining_links(texts: pa.Array, component: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between some texts, as few as join the components that the similar ones of them have."""
    text, found, n = hashed_shingles(texts)
    order = np.argsort(found, kind="stable")
    holders = text[order]  # of each shingle, side by side
    fresh = np.append(True, found[order][1:] != found[order][:-1]) if len(order) else np.empty(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    edges = np.append(np.flatnonzero(fresh), len(order))
    sizes, begin = np.bincount(text, minlength=n), np.searchsorted(text, np.arange(n + 1))
    label, out = np.unique(component, return_inverse=True)[1], []
    for i in range(n):
        other = label != label[i]
        if not other.any():
            break
        own = number[begin[i] : begin[i + 1]]
        both = np.bincount(holders[ranges(edges[own], edges[own + 1] - edges[own])], minlength=n)
        near = np.flatnonzero(other & (both >= similarity * (sizes + sizes[i] - both)))
        for j in near[np.unique(label[near], return_index=True)[1]].tolist():
            out.append((i, j))
            label[label == label[j]] = label[i]
    return out


def _links_within(buckets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links that join the components of each bucket (key, n, class, component, text), written."""
    many = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    rows = buckets.withColumn("blocks", many).withColumn("own", own).withColumn("met", F.explode(met)).select("key", "met.i", "met.j", "class", "component", "text")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(parts))  # two blocks at most
        kinds = group["class"].to_numpy()
        found = joining_links(group["text"].combine_chunks().cast(pa.string()), group["component"].to_numpy(), similarity)
        yield pa.RecordBatch.from_arrays([pa.array([kinds[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return materialize(rows.groupBy("key", "i", "j").applyInArrow(compare, "src long, dst long"), "links-within")


def _with_components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges).select(F.col("node").alias("class"), "component")
    return classes.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, and all rows without an id."""
    rows = _sketched(docs, text_col)
    one_id, one_text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    best = F.min(F.when(one_id.isNotNull(), F.struct(one_id.alias("id"), F.xxhash64(one_text).alias("hash"), F.col("__row").alias("row")))).alias("best")
    classes = materialize(rows.groupBy(F.col("__class").alias("class")).agg(F.min("__row").alias("row"), F.first("__fingerprint").alias("fingerprint"), best), "classes")
    firsts = rows.select(F.col("__row").alias("row"), "__keys", one_text.alias("text")).join(classes.select("class", "row"), "row")
    tree = tree_pairs(classes)
    bands = firsts.filter("class <> 0").select("class", F.explode("__keys").alias("key"))
    # Buckets of more than one class, with their least class in an order of its own.
    order = F.struct(F.xxhash64("class").alias("order"), "class")
    buckets = bands.groupBy("key").agg(F.min(order)["class"].alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(bands.join(buckets, "key").select("key", "class", "least"), "buckets")
    asked = met.select("class").union(tree.select("a")).union(tree.select("b")).distinct()
    texts = materialize(firsts.select("class", "text").join(asked, "class", "left_semi"), "bucket-texts")
    pairs = tree.union(met.filter("class <> least").select(F.col("least").alias("a"), F.col("class").alias("b"))).distinct()
    edges = _confirmed(pairs, texts, similarity)
    # Buckets whose classes lie in different components.
    placed = _with_components(met, edges)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    open_ = placed.join(mixed, "key", "left_semi").select("key", "class", "component")
    sized = open_.join(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").join(texts, "class")
    edges = edges.union(_links_within(sized, similarity))
    placed = _with_components(classes.select("class", "best"), edges)
    kept = placed.filter("best is not null").groupBy("component").agg(F.min("best")["row"].alias("__row"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    without_id = rows.filter(F.col(f"`{id_col}`").cast("long").isNull())
    return rows.join(kept, "__row", "left_semi").select(*own).unionByName(without_id.select(*own))
