"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import materialize, scratch, shared_dir  # noqa: F401

#: Text bytes that a Python task holds decoded at once (one longer text still goes alone).
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared URI, for use inside tasks (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of batches whose strings in column sum to about limit bytes at most."""
    for batch in batches:
        n = batch.num_rows
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
        ends, at = np.cumsum(sizes), 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: start, start+1, ... for each (start, length)."""
    total = int(lengths.sum())
    kind = np.int32 if total < 1 << 30 and (not len(starts) or int(starts.max()) < 1 << 30) else np.int64
    before = (np.cumsum(lengths) - lengths).astype(kind)
    return np.repeat(starts.astype(kind) - before, lengths) + np.arange(total, dtype=kind)
