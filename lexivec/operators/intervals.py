"""The narrowest interval around a point, for any intervals, in time that grows with their number.

An interval of whole numbers falls into at most two blocks of each power of two. Of all intervals that cover a block only the
narrowest matters, so each block keeps one, by an aggregate that is combined before the shuffle. A point lies in one block of
each power of two; it meets the blocks in an equi-join and takes the narrowest of at most LEVELS. A group with very many
intervals is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two that an interval's length may reach.
LEVELS = 32


def _inside(a: Column, b: Column, level: Column) -> tuple[Column, Column]:
    """The first and last block of a level that lie wholly between a and b."""
    size = F.pow(F.lit(2.0), level)
    return F.ceil(a / size), F.floor((b + 1) / size) - 1


def blocks(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """`intervals` once for each of its blocks (_level, _block). Those that end before they start have none."""
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    each = intervals.filter((a >= 0) & (a <= b)).withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2((b - a + 1).cast("double"))).cast("int"))))
    first, last = _inside(a, b, F.col("_level"))
    above_first, above_last = _inside(a, b, F.col("_level") + 1)
    each = each.withColumn("_block", F.explode(F.array_distinct(F.array(first, last))))
    parent = F.floor(F.col("_block") / 2)
    return each.filter(F.col("_block").between(first, last) & ~parent.between(above_first, above_last))


def narrowest(intervals: DataFrame, points: DataFrame, on: list[str], start: str, end: str, point: str, ties: list[str]) -> DataFrame:
    """`points` with the columns of the interval around each that is the shortest, of equals the first by `ties`. Points with
    none are left out. Rows with a null key, start or end don't count; `points` and `intervals` share the columns `on` only."""
    own = [c for c in intervals.columns if c not in on]
    rank = F.struct((F.col(end) - F.col(start)).alias("_width"), *ties)
    best = blocks(intervals, start, end).groupBy(*on, "_level", "_block").agg(F.min_by(F.struct(rank.alias("_rank"), *own), rank).alias("_best"))
    asked = points.select(*on, point).distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    asked = asked.withColumn("_block", F.floor(F.col(point) / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    found = asked.join(best, [*on, "_level", "_block"]).groupBy(*on, point).agg(F.min_by("_best", "_best._rank").alias("_best"))
    return points.join(found.select(*on, point, *[F.col(f"_best.{c}").alias(c) for c in own]), [*on, point])
