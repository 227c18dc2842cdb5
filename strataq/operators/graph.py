"""Graph closure over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..plans.shared import materialize

#: From so many edges on, a node's rows are dealt over several tasks, so that the hub of a large star
#: fills no single one; fewer edges than that fit in any task.
SALTED_FROM, SALTS = 1 << 20, 16
#: So few edges are settled in one task; the rounds give the same rows.
SMALL = 1 << 17
MAX_ROUNDS = 60


def _with_minimum(edges: DataFrame, salts: int) -> DataFrame:
    """(u, v, m): edges with the smallest neighbour of u, or u itself."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    if salts == 1:
        return edges.join(least, "u").select("u", "v", "m")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "salt"]).select("u", "v", "m")


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Edges in the shared folder, with their number and a hash of all, taken while they are written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("hash")), "components")
    return out, seen.get


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to (u, smallest of its component), for SMALL edges at most."""
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, ends = np.unique(np.concatenate((table["u"].to_numpy(), table["v"].to_numpy())), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:  # hook roots below each other, then flatten
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another.

    Alternates large-star and small-star rounds, each an aggregation and a join on shuffled edges,
    until every edge points at its component's smallest node: O(log n) rounds. Each round is written
    to the shared folder; once SMALL edges are left, of numbers, one task settles them. Null ends and
    self-loops are ignored; nodes without an edge have no row.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    numbers = edges.schema["u"].dataType == LongType()
    edges, now = _written(edges)
    for _ in range(MAX_ROUNDS):
        last = now
        if not now["n"]:
            break
        if now["n"] <= SMALL and numbers:
            edges = materialize(edges.coalesce(1).mapInArrow(_settle, "u long, v long"), "components")
            break
        salts = SALTS if now["n"] >= SALTED_FROM else 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, salts).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_minimum(large, salts)
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()
        edges, now = _written(small)
        if now == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
