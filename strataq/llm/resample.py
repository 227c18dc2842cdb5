"""Importance resampling of documents towards a target corpus, by hashed n-gram features.

Features are all runs of 1 to n words. Each task sorts the suffixes of its texts' word ids to depth n (a
suffix array per slice of texts); equal n-grams then lie side by side, in runs given by the common prefix
of neighbours. An n-gram is hashed once a run, and its bucket is scattered to all places of the run. The
bucket ids are written once and serve both the counts and the scores. Counts are summed in each task
before the shuffle: a task sends one row a bucket, so a frequent n-gram is no hot key.

A bucket's gain is the logarithm of its smoothed share in the target over that in the raw corpus; a
document's weight is the mean gain of its features. Gumbel noise from a hash of the id turns the top
scores into a draw without replacement. Ranks come from rows sorted by ranges, none through one task.

Nulls, empty and long texts: a null text is an empty one: no features, weight 0, never drawn for want of
words. Long texts go whole. A null id is hashed as an empty string and comes last among ties. Repeated rows count and are
drawn each by themselves; ties of score go to the smaller id. An empty table gives no rows; an empty target
leaves the smoothed gains. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .bytewords import alphanumeric_words, crcs_of, joined_crc, offsets_of
from .common import materialize, ranges, slices

BUCKETS, NGRAM = 10_000, 2
MIN_WORDS, PERCENT, SEED = 20, 25, 7
_SPACE = np.uint32(0xE96CCF45)  # CRC-32 of one space
_CODED = "doc_id long, n_words long, n_features long, buckets binary"


def _suffixes(ids: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """Places in the order of their next n word ids (fewer at the end of a text)."""
    base = int(ids.max(initial=0)) + 2
    rank = ids.astype(np.int64) + 1
    for step in range(1, n):
        after = np.zeros(len(ids), np.int64)
        after[: max(len(ids) - step, 0)] = ids[step:] + 1
        key = rank * base + np.where(left > step, after, 0)
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
    return np.argsort(rank, kind="stable") if n == 1 else order


def buckets_of(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids of all features, text by text, the n+1 borders of the texts in them, and their words."""
    words, borders = alphanumeric_words(texts)
    count = np.diff(borders)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    crcs, size = crcs_of(coded.dictionary), np.diff(offsets_of(coded.dictionary))
    text = np.repeat(np.arange(len(count)), count)
    left = borders[1:][text] - np.arange(len(ids))  # words from a place to its text's end
    order = _suffixes(ids, left, n) if len(ids) else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(sum(np.maximum(count - k, 0) for k in range(n)))))
    out, before = np.empty(ends[-1], np.uint16), ends[:-1].copy()
    same = np.ones(max(len(ids) - 1, 0), bool)
    for k in range(n):
        # Neighbours whose common prefix is over k words; those of the runs of n-grams of k + 1 words.
        here, whole = np.minimum(order + k, len(ids) - 1), left[order] > k
        same &= (ids[here[1:]] == ids[here[:-1]]) & whole[1:] & whole[:-1]
        heads = np.concatenate(([True], ~same)) & whole if len(ids) else np.empty(0, bool)
        first = order[heads]
        value = crcs[ids[first]]
        for j in range(1, k + 1):
            word = ids[first + j]
            value = joined_crc(joined_crc(value, np.full(len(value), _SPACE), np.ones(len(value), np.int64)), crcs[word], size[word])
        run = np.cumsum(heads) - 1
        places = order[whole]
        out[before[text[places]] + places - borders[text[places]]] = (value % np.uint32(buckets)).astype(np.uint16)[run[whole]]
        before += np.maximum(count - k, 0)
    return out, ends, count


def _coded(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found, ends, count = buckets_of(batch.column("text"), n, buckets)
        data = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer((2 * ends).astype(np.int64)), pa.py_buffer(found.astype("<u2"))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(np.diff(ends), pa.int64()), data.cast(pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    ends = offsets_of(column)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return data.view("<u2"), (ends - ends[0]) // 2


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n): a row per bucket that a task has."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        total += np.bincount(_flat(batch.column("buckets"))[0], minlength=buckets)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])


def _weighted(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, ends = _flat(batch.column("buckets"))
        sums = np.concatenate(([0], np.cumsum(gains[found])))
        count = np.diff(ends)
        weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(count, 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def code_features(docs: DataFrame, id_col: str | None, text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): bucket ids of a text's features as 16-bit integers."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("from 1 to 65,536 buckets")
    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(key.alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_coded, n=n, buckets=buckets), _CODED)


def count_buckets(coded: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets in use."""
    return coded.select("buckets").mapInArrow(partial(_counted, buckets=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain in thousandths, floored: as many numbers as there are buckets, whatever the corpus."""
    spark = raw.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = sorted(both.collect())
    s, t = (np.array([r[i] for r in rows], np.float64) for i in (1, 2))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null for those not drawn."""
    coded = materialize(code_features(docs, id_col, text_col, n, buckets), "features")
    gains = gains_of(count_buckets(coded, buckets), count_buckets(code_features(target, None, target_text_col, n, buckets), buckets), buckets)
    rows = coded.mapInArrow(partial(_weighted, gains=gains), "doc_id long, n_words long, n_features long, weight long")
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    scored = materialize(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))), "scores")
    enough = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * enough.count() // 100
    ranked = number_rows(enough.withColumns({"__last": F.col("doc_id").isNull(), "__down": -F.col("score")}), ["__down", "__last", "doc_id"], "rank", 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("__down", "__last")
    others = scored.filter(~(F.col("n_words") >= min_words)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others)
