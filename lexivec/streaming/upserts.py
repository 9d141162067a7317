"""The incremental index and the access counts, fed by streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_versions(changes: DataFrame, key: str = "path", order: str = "mtime") -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def upsert_stream(changes: DataFrame, checkpoint: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str = "path", order: str = "mtime") -> StreamingQuery:
    """Each micro-batch replaces the rows of its keys by their newest version. `write` gets the batch's number, so that a
    batch which is given again after a failure can be told from a new one."""

    def apply(batch: DataFrame, number: int) -> None:
        fresh = latest_versions(batch, key, order)
        old = read()
        write(old.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*old.columns)), number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_counts(accesses: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, path, rank, last_accessed) of a stream of (path, at timestamp), with a bound on late rows."""
    return accesses.withWatermark("at", late).groupBy(F.window("at", window), "path").agg(F.count("*").cast("double").alias("rank"), F.max(F.unix_timestamp("at")).alias("last_accessed"))
