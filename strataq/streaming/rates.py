"""Request rates and lockouts, by key and time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decide(times: list[float], state: tuple[float, int] | None, seconds: float, limit: int) -> tuple[list[bool], tuple[float, int] | None]:
    """Whether each of a key's ordered requests passes; the first opens a window that limit requests may use."""
    out = []
    for t in times:
        if state is None or t - state[0] >= seconds:
            state = (t, 0)
        state = (state[0], state[1] + 1)
        out.append(state[1] <= limit)
    return out, state


def rate_decisions(df: DataFrame, key: str, at: str, order: str, seconds: float = 1, limit: int = 30) -> DataFrame:
    """(order, key, allowed) of a batch: rows stream through each key's window in order of time.

    Rows are dealt and sorted by Spark; a task keeps one window, however many rows a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, opened, used, width = None, 0, 0, int(seconds * 1_000_000)
        for frame in batches:
            keys, at = frame["key"].to_numpy(), frame["at"].to_numpy("datetime64[us]").astype(np.int64)
            allowed = np.zeros(len(frame), bool)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(frame)]
            for a, b in zip(edges[:-1], edges[1:]):  # a step a window, not a row
                if a == b:
                    continue
                i = a
                if keys[a] == last:  # its window may still be open
                    i = a + int(np.searchsorted(at[a:b], opened + width))
                    allowed[a:i] = np.arange(used + 1, used + 1 + i - a) <= limit
                    used += i - a
                while i < b:
                    opened = int(at[i])
                    end = i + max(1, int(np.searchsorted(at[i:b], opened + width)))
                    used = end - i
                    allowed[i:end] = np.arange(1, used + 1) <= limit
                    i = end
                last = keys[a]
            yield pd.DataFrame({"id": frame["id"], "key": frame["key"], "allowed": allowed})

    rows = df.selectExpr(f"{order} as id", f"{key} as key", f"{at} as at").filter("key is not null and at is not null")
    kind = rows.schema["key"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    out = rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, f"id {kind[1]}, key {kind[0]}, allowed boolean")
    return out.withColumnsRenamed({"id": order, "key": key})


def rate_stream(events: DataFrame, key: str, at: str, seconds: float = 1, limit: int = 30) -> DataFrame:
    """The same on a stream, (key, at, allowed), with a key's open window as state that times out."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values("at")  # one key's rows of one micro-batch
        own = tuple(state.get) if state.exists else None
        allowed, own = decide([t.timestamp() for t in frame["at"]], own, seconds, limit)
        state.update(own)
        state.setTimeoutDuration(int(seconds * 1000) + 1)
        yield pd.DataFrame({"key": frame["key"], "at": frame["at"], "allowed": allowed})

    rows = events.selectExpr(f"{key} as key", f"cast({at} as timestamp) as at")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at timestamp, allowed boolean", "opened double, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


class _Lock:
    """One key's open window and lock, in microseconds; attempts during a lock are turned away uncounted."""

    def __init__(self, limit: int, window: float, lock: float, opened: int | None = None, used: int = 0, until: int | None = None):
        self.limit, self.window, self.lock = limit, int(window * 1_000_000), int(lock * 1_000_000)
        self.opened, self.used, self.until = opened, used, until

    def take(self, at: np.ndarray) -> list[int]:
        """The times at which locks begin, of ordered failures; a step a window, not a failure."""
        found, i, n = [], 0, len(at)
        while i < n:
            if self.until is not None:
                i += int(np.searchsorted(at[i:], self.until))
                if i == n:
                    break
                self.until = None
            if self.opened is None or at[i] - self.opened >= self.window:
                self.opened, self.used = int(at[i]), 0
            end = i + max(1, int(np.searchsorted(at[i:], self.opened + self.window)))
            missing = self.limit - self.used
            if end - i >= missing:
                i += missing
                found.append(int(at[i - 1]))
                self.until, self.opened, self.used = found[-1] + self.lock, None, 0
            else:
                self.used += end - i
                i = end
        return found


def lockouts(failures: DataFrame, key: str, at: str, limit: int = 5, window: float = 300, lock: float = 300) -> DataFrame:
    """(key, locked_from, locked_until): locks of a batch of failures.

    A window opens with a key's first failure and stays fixed; its limit-th failure locks the key. What comes
    during a lock is not counted, and the first failure after it opens a new window. Rows are dealt and
    sorted by Spark; a task keeps one window, however many rows a key has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, _Lock(limit, window, lock)
        for frame in frames:
            keys, times = frame["key"].to_numpy(), frame["at"].to_numpy("datetime64[us]").astype(np.int64)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(frame)]
            out: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if keys[a] != last:
                    last, state = keys[a], _Lock(limit, window, lock)
                out += [(last, t) for t in state.take(times[a:b])]
            starts = np.array([t for _, t in out], np.int64)
            yield pd.DataFrame({"key": pd.Series([k for k, _ in out], dtype=frame["key"].dtype), "locked_from": starts.view("datetime64[us]"), "locked_until": (starts + state.lock).view("datetime64[us]")})

    rows = failures.selectExpr(f"{key} as key", f"cast({at} as timestamp) as at").filter("key is not null and at is not null")
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, f"key {kind}, locked_from timestamp, locked_until timestamp")
    return out.withColumnRenamed("key", key)


def lockout_stream(failures: DataFrame, key: str, at: str, limit: int = 5, window: float = 300, lock: float = 300) -> DataFrame:
    """The same on a live stream, (key, locked_from, locked_until): a key's window and lock are state, dropped when
    it has been silent, by the clock, for longer than either."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used, until = state.get if state.exists else (None, 0, None)
        own = _Lock(limit, window, lock, opened, used, until)
        times = np.sort(np.concatenate([f["at"].to_numpy("datetime64[us]").astype(np.int64) for f in frames]))  # of one micro-batch
        starts = np.array(own.take(times), np.int64)
        state.update((own.opened, own.used, own.until))
        state.setTimeoutDuration(int(max(window, lock) * 1000) + 1)
        yield pd.DataFrame({"key": [name[0]] * len(starts), "locked_from": starts.view("datetime64[us]"), "locked_until": (starts + own.lock).view("datetime64[us]")})

    rows = failures.selectExpr(f"{key} as key", f"cast({at} as timestamp) as at").filter("key is not null and at is not null")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, locked_from timestamp, locked_until timestamp", "opened long, used long, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)
