"""Incremental upkeep of the file table: what changed, what is gone, and the counts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNCHANGED, TOUCHED, CHANGED, NEW, REMOVED = "unchanged", "touched", "changed", "new", "removed"


def plan(scan: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action). Equal size and time: unchanged; else an equal hash means that only times are renewed."""
    old = files.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_old"))
    both = scan.select("path", "size", "mtime", "content_hash", F.lit(True).alias("_new")).join(old, "path", "full")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    action = F.when(F.col("_new").isNull(), REMOVED).when(F.col("_old").isNull(), NEW).when(same, UNCHANGED).when(F.col("content_hash") == F.col("_hash"), TOUCHED).otherwise(CHANGED)
    return both.select("path", action.alias("action"))


def replace_paths(table: DataFrame, fresh: DataFrame, actions: DataFrame) -> DataFrame:
    """A table keyed by path after a run: rows of changed, new and removed paths go, fresh rows come."""
    gone = actions.filter(F.col("action").isin(CHANGED, NEW, REMOVED)).select("path")
    return table.join(gone, "path", "left_anti").unionByName(fresh.join(actions.filter(F.col("action").isin(CHANGED, NEW)).select("path"), "path", "left_semi"))


def stats(actions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: scanned, indexed, skipped, removed, chunks_written."""
    n = lambda *kinds: F.count(F.when(F.col("action").isin(*kinds), 1))
    counts = actions.agg(n(UNCHANGED, TOUCHED, CHANGED, NEW).alias("scanned"), n(CHANGED, NEW).alias("indexed"), n(UNCHANGED, TOUCHED).alias("skipped"), n(REMOVED).alias("removed"))
    written = chunks.join(actions.filter(F.col("action").isin(CHANGED, NEW)), "path", "left_semi").agg(F.count("*").alias("chunks_written"))
    return counts.crossJoin(written)  # one row each
