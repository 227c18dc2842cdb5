"""Duplicates and relations between assets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, extension, stem
from ..functions.vectors import hamming
from ..plans.shared import materialize
from .graph import connected_components

#: Sizes of a relation group, file kinds by priority, and backup suffixes.
GROUP_MIN, GROUP_MAX = 2, 10
SOURCES = {0: ["dwg", "dxf", "rvt", "rfa", "ifc", "skp", "max", "3ds", "blend"], 1: ["psd", "ai", "indd", "eps", "svg"]}
BACKUPS = ["bak", "dwl", "dwl2", "dwl3", "sv$", "$sv"]
VERSION = r"(?i)[ _.-]+(?:(?:v|r|rev\.?)[ _.-]*[0-9]+|(?:kopya|copy)[ _.-]*[0-9]*)$"


def duplicate_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(id, key, n, first): a row per member of each key that two rows or more share.

    Sizes are counted first, so a hot key is never gathered; the join can split it.
    """
    rows = df.select(key.alias("key"), F.col(id_col).alias("id")).filter("key is not null")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n >= 2")
    return rows.join(sizes, "key").select("id", "key", "n", "first")


def same_name_groups(df: DataFrame, name: str, id_col: str) -> DataFrame:
    return duplicate_groups(df, ascii_lower(F.col(name)), id_col)


def report_totals(groups: DataFrame) -> DataFrame:
    """One row: groups, their members, and rows that could go."""
    return groups.agg(F.count_distinct("key").alias("groups"), F.count(F.lit(1)).alias("members"), (F.count(F.lit(1)) - F.count_distinct("key")).alias("spare"))


def groups_of(groups: DataFrame, seed: int) -> DataFrame:
    """The members of the groups that hold one id."""
    return groups.join(groups.filter(F.col("id") == seed).select("key").distinct(), "key", "left_semi").select(*groups.columns)


def group_order(groups: DataFrame, score: str = "n") -> DataFrame:
    """Members by falling score of their group, then its first id, then their own."""
    return groups.orderBy(F.desc(score), "first", "id")


#: Hashes of a band value that a plain join compares, at most; hashes that a task takes at once, and that it compares all
#: with all; pairs that it holds.
SMALL, CROWD, BLOCK, FOUND = 64, 1 << 18, 1024, 1 << 16


def _cut(bits: list[int], parts: int) -> list[tuple[int, list[int]]]:
    """(mask, the other bits) of each of some bands of bits."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [(int(np.uint64(sum(1 << b for b in bits[low:high])).view(np.int64)), bits[:low] + bits[high:]) for low, high in zip(edges, edges[1:])]


def _place(path: int, distance: int, bits: int) -> tuple[int, list[int], list[int]]:
    """(mask of the bits shared, the other bits, masks of earlier bands) of a path of bands within bands; the bands of
    path p are p * (distance + 1) + 1 and so on, and path 0 has shared none."""
    steps, shared, left, before = [], 0, list(range(bits)), []
    while path:
        path, step = divmod(path - 1, distance + 1)
        steps.append(step)
    for step in reversed(steps):
        cuts = _cut(left, distance + 1)
        before += [mask for mask, _ in cuts[:step]]
        shared, left = shared | cuts[step][0], cuts[step][1]
    return shared, left, before


def _blocks(df: DataFrame, hash_col: str, distance: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows): pairs (a, b, d) within the distance of band values that SMALL hashes share at most,
    and the hashes of the others by path and the bits they share.

    A value is cut into distance + 1 bands, of which two values within the distance share one; a pair
    counts in the first band it shares. A group of over CROWD hashes is dealt on by bands of its other bits,
    where the same holds, until none is as large; a task cuts its group further in the same way.
    """
    values = df.select(F.col(hash_col).alias("h")).filter("h is not null").distinct()
    edges = [round(i * bits / (distance + 1)) for i in range(distance + 2)]
    cuts = list(zip(edges, edges[1:]))
    bands = F.array(*(F.struct(F.lit(i + 1).alias("path"), F.col("h").bitwiseAND(F.lit(_place(i + 1, distance, bits)[0])).alias("key")) for i in range(distance + 1)))
    banded = materialize(values.select("h", F.explode(bands).alias("band")).select("band.path", "band.key", "h"), "bands")
    count = lambda rows: materialize(rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "band-sizes")
    of = lambda rows, sizes: rows.join(sizes.select("path", "key"), ["path", "key"])
    sizes = count(banded)
    a = of(banded, sizes.filter(F.col("n") <= SMALL)).withColumnRenamed("h", "a")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    meets = (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance)
    for i, (low, high) in enumerate(cuts):
        meets = meets & ((F.col("path") <= i + 1) | (F.shiftrightunsigned(apart, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) != 0))
    pairs = a.join(banded.withColumnRenamed("h", "b"), ["path", "key"]).filter(meets).select("a", "b", hamming(F.col("a"), F.col("b")).cast("int").alias("d"))
    rows, level, first, sizes = [], banded, 1, sizes.filter(F.col("n") > SMALL)
    while True:
        fits = F.col("n") <= CROWD if len(_place(first, distance, bits)[1]) > distance else F.lit(True)
        rows.append(of(level, sizes.filter(fits)))
        over = sizes.filter(~fits)
        if over.isEmpty():
            break
        first = first * (distance + 1) + 1
        masks = F.array(*(F.lit(_place(first + p, distance, bits)[0]) for p in range(first * distance + 1)))
        below = of(level, over).select(F.explode(F.sequence(F.col("path") * (distance + 1) + 1, (F.col("path") + 1) * (distance + 1))).alias("path"), "h")
        level = materialize(below.select("path", F.col("h").bitwiseAND(F.get(masks, F.col("path") - first)).alias("key"), "h"), "bands")
        sizes = count(level)
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return pairs, out


def _runs(x: np.ndarray, ends: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) within the distance of runs of hashes; ends: where the run of each ends. All runs at once, by how far a
    and b lie apart in theirs."""
    at, apart = np.arange(len(x)), 0
    while len(at):
        apart += 1
        kept = at + apart < ends
        at, ends = at[kept], ends[kept]
        hit = at[np.bitwise_count((x[at] ^ x[at + apart]).view(np.uint64)) <= distance]
        yield x[hit], x[hit + apart]


def _apart(a: np.ndarray, b: np.ndarray, before: list[int]) -> np.ndarray:
    """Whether a and b differ in each of the earlier bands."""
    out = np.ones(len(a), bool)
    for mask in before:
        out &= (a ^ b) & mask != 0
    return out


def _pairs(x: np.ndarray, left: list[int], before: list[int], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) within the distance of distinct hashes that differ in the bits left alone, and in each earlier band. Over BLOCK
    hashes are cut into bands again; those that share one are compared, or cut in their turn."""
    todo = [(x, left, before)]
    while todo:
        own, left, before = todo.pop()
        if len(own) <= BLOCK or len(left) <= distance:
            for at in range(0, len(own), 256):
                i, j = np.nonzero(np.bitwise_count((own[at : at + 256, None] ^ own[None, at:]).view(np.uint64)) <= distance)
                i, j = at + i[i < j], at + j[i < j]
                kept = _apart(own[i], own[j], before)
                yield own[i[kept]], own[j[kept]]
            continue
        for mask, others in _cut(left, distance + 1):
            own = own[np.argsort(own & mask, kind="stable")]
            key = own & mask
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(heads, append=len(own))
            todo += [(own[h : h + n], others, list(before)) for h, n in zip(heads[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist())]
            few = (sizes > 1) & (sizes <= BLOCK)
            for a, b in _runs(own[np.repeat(few, sizes)], np.repeat(np.cumsum(sizes[few]), sizes[few]), distance):
                kept = _apart(a, b, before)
                yield a[kept], b[kept]
            before = [*before, mask]


def _near(x: np.ndarray, path: int, distance: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, d), a < b: pairs of a group within the distance that share no earlier band, about FOUND at a time."""
    held, n = [], 0
    _, left, before = _place(path, distance, bits)
    for a, b in _pairs(x, left, before, distance):
        if len(a):
            held.append((np.minimum(a, b), np.maximum(a, b), np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int32)))
            n += len(a)
        if n >= FOUND:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def hamming_pairs(df: DataFrame, hash_col: str, distance: int, bits: int = 64) -> DataFrame:
    """(a, b, d): hash values (a < b) within a distance, exactly; equal hashes are one value."""
    pairs, rows = _blocks(df, hash_col, distance, bits)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(parts))  # CROWD hashes at most
        for found in _near(group["h"].to_numpy(), group["path"][0].as_py(), distance, bits):  # so that a task holds few pairs
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "d"])

    return pairs.unionByName(rows.groupBy("path", "key").applyInArrow(compare, "a long, b long, d int"))


def _near_trees(df: DataFrame, hash_col: str, distance: int, bits: int) -> DataFrame:
    """(a, b, d): for each value of each group that has a partner there, an edge to the least of those it is
    linked with, and the distance of its farthest partner: a row a member, and a row a pair only where SMALL
    hashes share a band at most."""
    pairs, rows = _blocks(df, hash_col, distance, bits)

    def compare(group: pa.Table) -> pa.Table:
        values = np.sort(group["h"].to_numpy())
        label, worst = np.arange(len(values)), np.zeros(len(values), np.int32)
        for a, b, d in _near(values, group["path"][0].as_py(), distance, bits):
            a, b = np.searchsorted(values, a), np.searchsorted(values, b)
            np.maximum.at(worst, a, d)
            np.maximum.at(worst, b, d)
            while True:
                low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                if (low == high).all():
                    break
                np.minimum.at(label, high, low)
                while (label[label] != label).any():
                    label = label[label]
        held = worst > 0
        return pa.table({"a": values[label[held]], "b": values[held], "d": worst[held]})

    return pairs.unionByName(rows.groupBy("path", "key").applyInArrow(compare, "a long, b long, d int"))


def visual_groups(df: DataFrame, id_col: str, hash_col: str, distance: int, bits: int = 64) -> DataFrame:
    """(id, component, score): rows linked by near hashes; score from the worst edge."""
    values = materialize(df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("h is not null"), "hashes")  # computed once
    edges = materialize(_near_trees(values, "h", distance, bits), "near-hashes")
    nodes = connected_components(edges, "a", "b")
    worst = edges.join(nodes.withColumnRenamed("node", "b"), "b").groupBy("component").agg(F.max("d").alias("worst"))
    placed = values.join(nodes.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n >= 2").join(worst, "component", "left")
    score = F.expr("100 - (coalesce(worst, 0) * 100 + 32) div 64")
    return placed.join(sizes, "component").select("id", F.col("first").alias("component"), score.alias("score"))


def priority(ext: Column) -> Column:
    out = F.lit(2)
    for level, names in SOURCES.items():
        out = F.when(ext.isin(names), level).otherwise(out)
    return out


def derived_relations(assets: DataFrame) -> DataFrame:
    """(src, dst, kind): files of one folder and stem to the best source among them."""
    rows = assets.select("id", "folder", ascii_lower(stem(F.col("file_name"))).alias("stem"), extension(F.col("file_name")).alias("ext")).filter("ext is not null and not stem rlike '^[0-9]+$'")
    rows = rows.withColumn("priority", priority(F.col("ext")))
    groups = rows.groupBy("folder", "stem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ext").alias("kinds"), F.min_by(F.struct("id", "ext"), F.struct("priority", "id")).alias("hub"))
    groups = groups.filter(f"n between {GROUP_MIN} and {GROUP_MAX} and kinds >= 2")
    return rows.join(groups, ["folder", "stem"]).filter("id != hub.id and ext != hub.ext").select(F.col("hub.id").alias("src"), F.col("id").alias("dst"), F.lit("derived").alias("kind"))


def version_relations(assets: DataFrame) -> DataFrame:
    """(src, dst, kind): names that differ by a version mark, to the unmarked or first one."""
    name = stem(F.col("file_name"))
    rows = assets.select("id", ascii_lower(F.regexp_replace(name, VERSION, "")).alias("base"), extension(F.col("file_name")).alias("ext"), name.rlike(VERSION).alias("marked"), ascii_lower(F.col("file_name")).alias("name"))
    groups = rows.filter("base != ''").groupBy("base", "ext").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.count_if("marked").alias("marks"), F.min_by("id", F.struct("marked", "id")).alias("hub"))
    groups = groups.filter(f"n between {GROUP_MIN} and {GROUP_MAX} and names = n and marks >= 1")
    groups = groups.select(F.col("base").alias("__base"), F.col("ext").alias("__ext"), "hub")
    return rows.join(groups, (F.col("base") == F.col("__base")) & F.col("ext").eqNullSafe(F.col("__ext"))).filter("id != hub").select(F.col("hub").alias("src"), F.col("id").alias("dst"), F.lit("version").alias("kind"))


def backup_relations(assets: DataFrame) -> DataFrame:
    """(src, dst, kind): backups to the best source of the same stem."""
    rows = assets.select("id", "folder", ascii_lower(stem(F.col("file_name"))).alias("stem"), extension(F.col("file_name")).alias("ext"))
    sources = rows.filter(~F.col("ext").isin(BACKUPS)).groupBy("folder", "stem").agg(F.min_by("id", F.struct(priority(F.col("ext")), F.col("id"))).alias("src"))
    return rows.filter(F.col("ext").isin(BACKUPS)).join(sources, ["folder", "stem"]).select("src", F.col("id").alias("dst"), F.lit("backup").alias("kind"))


def new_relations(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Relations whose pair is in no existing one, in either direction."""
    pair = lambda df: df.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    fresh = pair(found).dropDuplicates(["lo", "hi"])
    return fresh.join(pair(existing).select("lo", "hi").distinct(), ["lo", "hi"], "left_anti").select("src", "dst", "kind")


def relations_of(relations: DataFrame) -> DataFrame:
    """(asset, other, kind, outgoing): each relation seen from both ends."""
    out = relations.select(F.col("src").alias("asset"), F.col("dst").alias("other"), "kind", F.lit(True).alias("outgoing"))
    return out.unionByName(relations.select(F.col("dst").alias("asset"), F.col("src").alias("other"), "kind", F.lit(False).alias("outgoing")))
