"""Results that cost a call or a long search, kept by what they depend on.

A cache is a segmented table (key, generation, value): `key` is a hash of everything that the value depends on, settings
included, `generation` that of the index for values which depend on it, else 0. Values of older generations are masked on
read and go at the next write. Misses are an anti-join, so only they are worked out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import SegmentedTable

SCHEMA = "key string, generation long, value string"


def key_of(kind: str, **parts) -> str:
    """The key of one value: the kind and every part, in one order."""
    return hashlib.sha256(json.dumps([kind, parts], sort_keys=True, default=str).encode()).hexdigest()


def keys_of(kind: str, column: str, **parts) -> F.Column:
    """Keys of many values that differ in a column; null counts as empty."""
    return F.sha2(F.concat_ws("\x01", F.lit(key_of(kind, **parts)), F.coalesce(F.col(column).cast("string"), F.lit(""))), 256)


class Cache:
    def __init__(self, table: SegmentedTable, generation: int = 0):
        self.table, self.generation = table, generation

    def rows(self) -> DataFrame:
        """(key, value) that count in this generation."""
        return self.table.read().filter(F.col("generation").isin(0, self.generation)).select("key", "value")

    def get(self, key: str) -> str | None:
        row = self.rows().filter(F.col("key") == key).first()
        return row.value if row else None

    def put(self, rows: DataFrame, lasting: bool = True) -> Cache:
        """The cache with more rows (key, value); with `lasting` they outlive this generation."""
        stale = self.table.read().filter(~F.col("generation").isin(0, self.generation)).select("key")
        fresh = rows.select("key", F.lit(0 if lasting else self.generation).cast("long").alias("generation"), "value")
        return Cache(self.table.appended(fresh, stale.unionByName(rows.select("key"))).compacted(), self.generation)

    def put_one(self, key: str, value: str, lasting: bool = True) -> Cache:
        return self.put(self.table.spark.createDataFrame([(key, value)], "key string, value string"), lasting)

    def filled(self, wanted: DataFrame, work_out: Callable[[DataFrame], DataFrame]) -> tuple[Cache, DataFrame]:
        """The cache that holds every `wanted` row (key, ..), and (key, value) of these. `work_out` gets the rows that are
        missing, once for each key, and gives (key, value)."""
        missing = wanted.dropDuplicates(["key"]).join(self.rows().select("key"), "key", "left_anti")
        cache = self if missing.isEmpty() else self.put(work_out(missing).select("key", F.col("value").cast("string").alias("value")))
        return cache, cache.rows().join(wanted.select("key"), "key", "left_semi")
