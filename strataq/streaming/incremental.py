"""Incremental indexing and change feeds on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .rates import rate_decisions, rate_stream


def index_new(spark: SparkSession, source: str, schema, index_path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Index whatever files a folder has gained since the last run, then stop.

    Every micro-batch drops keys that the index has, builds the rest and appends them to a folder of
    its own, so a batch that is run again replaces what it wrote.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(index_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.option("basePath", index_path).parquet(f"{index_path}/epoch=*").filter(F.col("epoch") != epoch).select(key)
            fresh = fresh.join(done, key, "left_anti")
        build(fresh).write.mode("overwrite").parquet(f"{index_path}/epoch={epoch}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def throttle(events: DataFrame, key: str, at: str, seconds: float = 1) -> DataFrame:
    """(key, at) of the events that open a gap: the first of a key, then the first one seconds or more after
    the last that was let through; on a stream or a table."""
    if events.isStreaming:
        return rate_stream(events, key, at, seconds, limit=1).filter("allowed").selectExpr(f"key as {key}", f"at as {at}")
    rows = events.selectExpr(key, f"cast({at} as timestamp) as {at}", "monotonically_increasing_id() as __id")
    return rate_decisions(rows, key, at, f"struct({at}, __id)", seconds, limit=1).filter("allowed").selectExpr(key, f"`struct({at}, __id)`.{at} as {at}")


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, key, n) of a stream with a bound on lateness."""
    rows = events.withColumn("__at", F.col(at).cast("timestamp"))
    return rows.withWatermark("__at", late).groupBy(F.window("__at", window), key).agg(F.count(F.lit(1)).alias("n"))


def feed(log: DataFrame, since: int, limit: int = 500) -> DataFrame:
    """The log after a cursor, oldest first."""
    return log.filter(F.col("id") > since).orderBy("id").limit(max(1, min(limit, 500)))
