"""Progress of stream queries as a table of few rows."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Fixed value: seconds between two rows of a stage, its first and last ones aside.
GAP = 0.15
ROWS = "stage string, n long, processed long, total long, at double"


class ProgressLog(StreamingQueryListener):
    """Writes how many rows a named query has taken in: the first count, then one per GAP seconds, and the last.

    A row is a small file in the folder, written by the driver when it is due, so rows outlive the session and
    nothing is gathered. Counts grow; the last one is the number of all rows that were read.
    """

    def __init__(self, spark: SparkSession, folder: str, totals: dict[str, int] | None = None, gap: float = GAP, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.totals, self.gap, self.clock = spark, folder.rstrip("/"), totals or {}, gap, clock
        self.lock = threading.Lock()
        self.names: dict[str, str] = {}  # by the query's id, while it runs
        self.processed: dict[str, int] = {}
        self.written: dict[str, tuple[int, float, int]] = {}  # rows, time and count of the last one

    def onQueryStarted(self, event) -> None:
        with self.lock:
            name = event.name or str(event.id)
            self.names[str(event.id)] = name
            self.processed.setdefault(name, 0)

    def onQueryProgress(self, event) -> None:
        self.add(event.progress.name or str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            name = self.names.pop(str(event.id), None)
            if name is not None:
                self._write(name, last=True)

    def add(self, stage: str, n: int) -> None:
        """Counts rows of a stage; batch jobs call it between their steps."""
        with self.lock:
            self.processed[stage] = self.processed.get(stage, 0) + n
            self._write(stage, last=self.processed[stage] >= self.totals.get(stage, float("inf")))

    def _write(self, stage: str, last: bool) -> None:
        n, at, count = self.written.get(stage, (0, float("-inf"), -1))
        now, processed = self.clock(), self.processed[stage]
        if processed == count or not (last or n == 0 or now - at >= self.gap):
            return
        row = json.dumps({"stage": stage, "n": n, "processed": processed, "total": self.totals.get(stage), "at": now})
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{abs(hash(stage)):016x}-{n:08d}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(row.encode() + b"\n"))
        out.close()
        self.written[stage] = (n + 1, now, processed)


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """(stage, n, processed, total, at) of what a ProgressLog has written, in order."""
    return spark.read.schema(ROWS).json(folder).orderBy("stage", "n")
