"""Changes of folders, from a stream of their listings.

A scanner writes a listing of each root now and then: rows of (root, path, size_bytes, modified_at, listed_at).
State is kept by path, so a root of any size is spread over all tasks: a path that was not there is created, one of
another size or time is modified, and one that the next listing lacks is removed, which a timer tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CREATED, MODIFIED, REMOVED = "created", "modified", "removed"
CHANGES = "root string, path string, kind string, at timestamp"
_SEEN = "size_bytes long, modified_at long, listed_us long"


def use_keyed_state(spark: SparkSession) -> None:
    """The state store that timers need; set before such a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Path(StatefulProcessor):
    """What the last listing said of one path; it is gone if no listing has named it for every seconds."""

    def __init__(self, every: float):
        self.every = int(every * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.seen.get()
        out = []
        frame = pd.concat(list(rows))  # one path's entries of one micro-batch
        listed = frame["listed_at"].to_numpy("datetime64[us]").astype("int64")
        for at, size, modified in sorted(zip(listed.tolist(), frame["size_bytes"].tolist(), frame["modified_at"].tolist())):
            if last is not None and at <= last[2]:
                continue  # a repeated or late listing
            if last is None:
                out.append((CREATED, at))
            elif (size, modified) != tuple(last[:2]):
                out.append((MODIFIED, at))
            last = (size, modified, at)
        self.seen.update(tuple(last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last[2] // 1000 + self.every)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield self._rows(key, [(REMOVED, expiredTimerInfo.getExpiryTimeInMs() * 1000)])

    def _rows(self, key, found: list[tuple[str, int]]) -> pd.DataFrame:
        times = pd.Series([at for _, at in found], dtype="int64").astype("datetime64[us]")
        text = {"root": [key[0]] * len(found), "path": [key[1]] * len(found), "kind": [k for k, _ in found]}
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in text.items()} | {"at": times})

    def close(self) -> None:
        pass


def folder_changes(listings: DataFrame, every: float, late: float = 0) -> DataFrame:
    """(root, path, kind, at) of a stream of listings that come every so many seconds at most.

    at: the listing that showed the change; of a removal, the one that was due without the path. A removal shows
    with the micro-batch after the listing that lacks the path, and late listings of up to late seconds are waited for.
    """
    rows = listings.selectExpr("root", "path", "cast(size_bytes as long) as size_bytes", "cast(modified_at as long) as modified_at", "cast(listed_at as timestamp) as listed_at")
    rows = rows.filter("root is not null and path is not null and listed_at is not null").withWatermark("listed_at", f"{late} seconds")
    return rows.groupBy("root", "path").transformWithStateInPandas(_Path(every), CHANGES, "Append", "EventTime")


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(root, path, kind) between two listings of the same roots, as tables; a path listed twice counts once."""
    from pyspark.sql import functions as F

    side = lambda df, p: df.groupBy("root", "path").agg(F.max(F.struct("listed_at", "size_bytes", "modified_at")).alias(p))
    both = side(before, "a").join(side(after, "b"), ["root", "path"], "full")
    same = F.struct("a.size_bytes", "a.modified_at").eqNullSafe(F.struct("b.size_bytes", "b.modified_at"))
    kind = F.when(F.col("a").isNull(), CREATED).when(F.col("b").isNull(), REMOVED).when(~same, MODIFIED)
    return both.select("root", "path", kind.alias("kind")).filter("kind is not null")
