"""Checks of catalogued files where they lie: content against its hash, and kind against the first bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import stride_sample

#: Extensions of old binary and of packed office files, the first bytes of either, and rows of a report.
BINARY, PACKED = ["doc", "dot", "xls", "xlt", "ppt", "pps", "pot"], ["docx", "docm", "dotx", "dotm", "xlsx", "xlsm", "xltx", "xltm", "pptx", "pptm", "ppsx", "potx"]
OLE, ZIP = "D0CF11E0A1B11AE1", "504B"
REPORTED = 200


def _with_bytes(df: DataFrame, path: str, name: str, kind: str, take: Callable) -> DataFrame:
    """The rows with what take(open file) gives of each path; null where it cannot be read. A file at a time."""

    def one(p: str | None):
        try:
            files, at = pafs.FileSystem.from_uri(p)
            with files.open_input_stream(at) as stream:
                return take(stream)
        except Exception:  # a file that is not there is a null
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: pd.Series([one(p) for p in frame[path]], index=frame.index, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, {name} {kind}")


def _sha256(stream) -> str:
    digest = hashlib.sha256()
    while block := stream.read(1 << 20):
        digest.update(block)
    return digest.hexdigest()


def fixity(assets: DataFrame, percent: int = 100) -> DataFrame:
    """(id, path, state) of a sample of the assets (id, path, content_hash) that have a hash: every
    ceil(100 / percent)-th by path, read again; ok, mismatch or missing."""
    sample = stride_sample(assets.filter("content_hash is not null").select("id", "path", "content_hash"), "path", percent)
    read = _with_bytes(sample.select("id", "path", "content_hash"), "path", "__now", "string", _sha256)
    state = F.when(F.col("__now").isNull(), "missing").when(F.col("__now") == F.col("content_hash"), "ok").otherwise("mismatch")
    return read.select("id", "path", state.alias("state"))


def office_formats(assets: DataFrame) -> DataFrame:
    """(id, path, ext, state) of office files by their first eight bytes: legacy_binary, extension_mismatch,
    unknown or ok; files that cannot be read have no row."""
    wanted = assets.filter(F.lower("ext").isin(BINARY + PACKED)).select("id", "path", "ext")
    first = F.upper("__first")
    old = F.lower("ext").isin(BINARY)
    ole, packed = F.startswith(first, F.lit(OLE)), F.startswith(first, F.lit(ZIP))
    state = F.when(~ole & ~packed, "unknown").when(old & ole, "legacy_binary").when(old == packed, "extension_mismatch").otherwise("ok")
    rows = _with_bytes(wanted, "path", "__first", "string", lambda stream: stream.read(8).hex())
    return rows.filter("__first is not null").select("id", "path", "ext", state.alias("state"))


def check_report(states: DataFrame, fine: str = "ok") -> tuple[DataFrame, DataFrame]:
    """(state, n) and the first REPORTED rows that are not fine, by path."""
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n")), states.filter(F.col("state") != fine).orderBy("path", "id").limit(REPORTED)
