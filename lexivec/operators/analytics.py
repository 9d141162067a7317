"""Small rollups: the best hit of each file, the directory that a query points to, and decayed access counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import directory

HALF_SCALE_DAYS, FRECENCY_SHARE = 14.0, 0.5


def guide(results: DataFrame, files: int = 8) -> DataFrame:
    """The best result of each path, the best paths first."""
    best = results.groupBy("path").agg(F.max_by(F.struct("chunk_id", "score"), F.struct("score", -F.col("chunk_id"))).alias("b") if dict(results.dtypes)["chunk_id"] != "string" else F.min_by(F.struct("chunk_id", "score"), F.struct(-F.col("score"), "chunk_id")).alias("b"))
    return best.select("path", "b.chunk_id", "b.score").orderBy(F.desc("score"), "path").limit(files)


def decayed(rank: Column, last: Column, now: Column) -> Column:
    """A count of accesses, fading over two weeks; times are unix seconds."""
    return rank * F.exp(-F.greatest(F.lit(0), now - last) / 86400.0 / HALF_SCALE_DAYS)


def directory_vote(results: DataFrame, frecency: DataFrame, now: Column, limit: int | None = 1, digits: int | None = None) -> DataFrame:
    """(directory, score): reciprocal ranks of a directory's results plus a share of its decayed accesses."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # the results of one query
    votes = results.withColumn("rank", place).groupBy(directory(F.col("path")).alias("directory")).agg(F.sum(F.lit(1.0) / F.col("rank")).alias("vote"))
    seen = frecency.select(F.col("path").alias("directory"), decayed(F.col("rank"), F.col("last_accessed"), now).alias("seen"))
    score = F.col("vote") + FRECENCY_SHARE * F.coalesce("seen", F.lit(0.0))
    scored = votes.join(seen, "directory", "left").select("directory", (F.round(score, digits) if digits is not None else score).alias("score"))
    ordered = scored.orderBy(F.desc("score"), "directory")
    return ordered.limit(limit) if limit else ordered


def record_accesses(frecency: DataFrame, accesses: DataFrame) -> DataFrame:
    """(path, rank, last_accessed) after more accesses (path, at)."""
    new = accesses.select("path", F.lit(1.0).alias("rank"), F.col("at").alias("last_accessed"))
    return frecency.select("path", "rank", "last_accessed").unionByName(new).groupBy("path").agg(F.sum("rank").alias("rank"), F.max("last_accessed").alias("last_accessed"))


def unique_paths(results: DataFrame) -> DataFrame:
    return results.select("path").distinct().orderBy("path")
