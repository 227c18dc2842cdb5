"""Vector, colour and shape similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.color import palette_distance
from ..plans.shared import materialize

#: Query vectors that are broadcast at once.
BLOCK = 4096
#: Entries of a palette, at most.
PALETTE_MAX = 4096


#: Scores that a task holds at once, and rows that it sends on at once.
SCORES, ROWS = 1 << 20, 1 << 16


def scores_of(goal: np.ndarray, own: np.ndarray, metric: str) -> np.ndarray:
    """Cosines (0 where a vector has no length), or distances with their sign turned."""
    if metric == "cosine":
        length = np.linalg.norm(goal, axis=1)[:, None] * np.linalg.norm(own, axis=1)[None, :]
        return np.where(length == 0, 0.0, goal @ own.T / np.where(length == 0, 1, length))
    return -np.sqrt(np.maximum((goal**2).sum(1)[:, None] + (own**2).sum(1)[None, :] - 2 * goal @ own.T, 0))


def _parts_of(batch: pa.RecordBatch, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, ids) of a batch (v, id), so many at a time that their scores stay within SCORES."""
    step = max(1, SCORES // max(queries, 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        own = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
        yield own, part.column("id").to_numpy(zero_copy_only=False)


class _Best:
    """The k best ids of each query so far; of equal scores the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, score: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Scores of queries (by number; all in order if none are named) by ids; -inf is no candidate."""
        enough = np.full(len(score), -np.inf)
        if score.shape[1] > self.k:
            enough = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k]
        row, column = np.nonzero((score >= enough[:, None]) & (score > -np.inf))
        every = np.concatenate((self.query, row if queries is None else queries[row]))
        held, value = np.concatenate((self.id, ids[column])), np.concatenate((self.score, score[row, column]))
        order = np.lexsort((held, -value, every))
        query = every[order]
        first = np.searchsorted(query, query)
        kept = order[np.arange(len(order)) - first < self.k]
        self.query, self.id, self.score = every[kept], held[kept], value[kept]

    def rows(self, names: np.ndarray, falls: bool) -> pa.RecordBatch:
        columns = [pa.array(names[self.query].astype(np.int64)), pa.array(self.id), pa.array(self.score if falls else -self.score)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])


def knn(vectors: DataFrame, queries: DataFrame, id_col: str, query_id: str, vector: str, k: int, metric: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """(query, id, score, rank): the k best vectors of every query, exactly.

    Queries are broadcast in blocks of at most BLOCK; each task scores its vectors by one matrix
    product a batch and sends on its own k best of each query, so the shuffle holds k rows per query
    and task. score is the cosine (0 for a vector without length) or the distance (metric "l2").
    """
    out = None
    blocks = max(1, -(-queries.count() // BLOCK))
    falls = metric == "cosine"
    for b in range(blocks):
        part = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).toPandas()
        if not len(part):
            continue
        data = (part["q"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float64))
        shared = vectors.sparkSession.sparkContext.broadcast(data)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, goal = shared.value
            best = _Best(k)
            for batch in batches:
                for own, ids in _parts_of(batch, len(names)):
                    score = scores_of(goal, own, metric)
                    if exclude_self:
                        score[names[:, None] == ids[None, :]] = -np.inf
                    best.add(score, ids)
            yield best.rows(names, falls)

        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("v is not null").mapInArrow(run, "query_id long, id long, score double")
        out = rows if out is None else out.union(rows)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    order = F.desc("score") if falls else F.asc("score")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).filter(F.col("rank") <= k)


def best_per_group(vectors: DataFrame, queries: DataFrame, group: str, query_id: str, vector: str) -> DataFrame:
    """(query_id, group, score): the best cosine of each query with the vectors of each group, exactly.

    Queries are broadcast in blocks of at most BLOCK. A task scores so many vectors at a time that their scores stay
    within SCORES, keeps the best of each query and group so far, and sends them on when they are as many.
    """
    out, blocks = None, max(1, -(-queries.count() // BLOCK))
    kind = vectors.schema[group].dataType.simpleString()
    schema = f"query_id long, `{group}` {kind}, score double"
    for b in range(blocks):
        part = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).toPandas()
        if not len(part):
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((part["q"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, goal = shared.value
            held: dict[object, np.ndarray] = {}  # of each group, the best score of each query
            step, many = max(1, SCORES // len(names)), max(1, ROWS // len(names))

            def rows_of(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
                found = list(held)
                for at in range(0, len(found), many):
                    some = found[at : at + many]
                    columns = [pa.array(np.tile(names, len(some))), pa.array(some, kind).take(pa.array(np.repeat(np.arange(len(some)), len(names)))), pa.array(np.concatenate([held[g] for g in some]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", group, "score"])
                held.clear()

            kind = None
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    own = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    coded = part.column(group).dictionary_encode()
                    kind, codes = coded.dictionary.type, coded.indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(codes, kind="stable")
                    heads = np.flatnonzero(np.diff(codes[order], prepend=-1))
                    best = np.maximum.reduceat(scores_of(goal, own[order], "cosine"), heads, axis=1)
                    for i, g in enumerate(coded.dictionary.take(pa.array(codes[order][heads])).to_pylist()):
                        held[g] = np.maximum(held[g], best[:, i]) if g in held else best[:, i].copy()
                    if len(held) * len(names) > SCORES:
                        yield from rows_of(kind)
            if held:
                yield from rows_of(kind)

        rows = vectors.select(F.col(group), F.col(vector).alias("v")).filter(F.col("v").isNotNull() & F.col(group).isNotNull()).mapInArrow(run, schema)
        out = rows if out is None else out.union(rows)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return out.groupBy("query_id", group).agg(F.max("score").alias("score"))


def best_of_regions(hits: DataFrame, asset: str, score: str) -> DataFrame:
    """An asset's best region."""
    return hits.groupBy(asset).agg(F.max(score).alias(score))


def near_colour(df: DataFrame, key: str, colors: str, target: tuple[int, int, int], max_delta: float = 25.0, min_share: float = 5.0, k: int = 50) -> DataFrame:
    """Assets by how near some colour of enough share comes."""
    rows = df.select(key, palette_distance(F.col(colors), target, min_share).alias("delta"))
    return rows.filter(F.col("delta") <= max_delta).orderBy("delta", key).limit(k)


def nearest_label(df: DataFrame, dim: DataFrame, distance, value: str) -> DataFrame:
    """The nearest entry of a small dimension (a palette) for every row; dim is of fixed size."""
    found = dim.limit(PALETTE_MAX + 1).collect()
    if len(found) > PALETTE_MAX:
        raise ValueError(f"a dimension of more than {PALETTE_MAX} entries is no palette")
    if not found:
        return df.withColumn("nearest", F.lit(None))
    entries = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in dim.columns)) for r in found))
    best = F.array_min(F.transform(entries, lambda e: F.struct(distance(e).alias("distance"), e[value].alias(value))))
    return df.withColumn("nearest", best)


# An index of cells: vectors lie in order of the nearest of some centres, and a search reads the cells it probes.

#: Vectors that the centres are fitted on at most, centres at most, rounds of fitting.
SAMPLE, CELLS, FIT_ROUNDS = 32_768, 1024, 12


@dataclass
class VectorIndex:
    """Rows (cell, id, v, and kept columns) in ranges of cells, and the cells' centres (of unit length for cosines)."""

    rows: DataFrame
    centres: np.ndarray
    metric: str


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def fit_centres(sample: np.ndarray, cells: int, metric: str) -> np.ndarray:
    """Means of k-means clusters of a sample; a centre that loses all its vectors moves to a drawn one."""
    rng = np.random.default_rng(13)
    x = _unit(sample) if metric == "cosine" else sample
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        own = np.argmax(scores_of(x, centres, "l2"), axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
        centres = _unit(centres) if metric == "cosine" else centres
    return centres


def build_vector_index(vectors: DataFrame, id_col: str, vector: str, metric: str = "cosine", cells: int | None = None, keep: tuple[str, ...] = ()) -> VectorIndex:
    """Write an index of all vectors; cells: about four times the root of their number by default. The centres are fitted on
    SAMPLE vectors at most, the first by a hash of the id; keep: columns that searches filter by."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), *keep).filter("v is not null and id is not null")
    if cells is None:
        cells = int(max(1, min(CELLS, 4 * rows.count() ** 0.5)))
    found = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["v"]
    sample = np.stack(found.to_numpy()).astype(np.float64) if len(found) else np.empty((0, 1))
    centres = fit_centres(sample, cells, metric) if len(sample) else np.empty((0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.empty(batch.num_rows, np.int32)
            at = 0
            for own, _ in _parts_of(batch, len(centres)):
                cell[at : at + len(own)] = np.argmax(scores_of(_unit(own) if metric == "cosine" else own, centres, "l2"), axis=1)
                at += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", *batch.schema.names])

    schema = StructType([StructField("cell", IntegerType()), *rows.schema.fields])
    placed = rows.mapInArrow(place, schema).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    return VectorIndex(materialize(placed, "vector-index"), centres, metric)


def search_cells(index: VectorIndex, queries: DataFrame, query_id: str, vector: str, k: int, probes: int, where: Column | None = None, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank) as knn gives them, of the vectors in each query's nearest cells.

    Probed cells are read and scored exactly; where: a condition on kept columns, which holds before the k best
    are taken. With all cells probed the result is knn's.
    """
    out, metric = None, index.metric
    falls = metric == "cosine"
    blocks = max(1, -(-queries.count() // BLOCK))
    for b in range(blocks):
        part = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).filter("v is not null").toPandas()
        if not len(part) or not len(index.centres):
            continue
        goal = np.stack(part["v"].to_numpy()).astype(np.float64)
        near = scores_of(_unit(goal) if falls else goal, index.centres, "l2")
        chosen = np.argsort(-near, axis=1, kind="stable")[:, : max(1, probes)]
        asked: dict[int, list[int]] = {}
        for q, cells in enumerate(chosen.tolist()):
            for c in cells:
                asked.setdefault(c, []).append(q)
        data = (part["q"].to_numpy(), goal, {c: np.array(qs) for c, qs in asked.items()})
        shared = index.rows.sparkSession.sparkContext.broadcast(data)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, goal, asked = shared.value
            best = _Best(k)
            for batch in batches:
                cells = batch.column("cell").to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
                for a, e in zip(edges[:-1], edges[1:]):
                    qs = asked.get(int(cells[a])) if e > a else None
                    if qs is None:
                        continue
                    for own, ids in _parts_of(batch.slice(a, e - a), len(qs)):
                        score = scores_of(goal[qs], own, metric)
                        if exclude_self:
                            score[names[qs][:, None] == ids[None, :]] = -np.inf
                        best.add(score, ids, qs)
            yield best.rows(names, falls)

        rows = index.rows.filter(F.col("cell").isin(sorted(asked)))  # reaches the scan: other cells are not read
        rows = (rows if where is None else rows.filter(where)).select("cell", "id", "v").mapInArrow(run, "query_id long, id long, score double")
        out = rows if out is None else out.union(rows)
    if out is None:
        return index.rows.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    order = F.desc("score") if falls else F.asc("score")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).filter(F.col("rank") <= k)
