"""Tables that grow by segments: a run writes what it brings and what it takes away, never the rest.

A segment is a folder with `rows` and `gone`. `gone` holds keys whose rows in every older segment no longer count; rows of the
segment itself do. A read joins the rows with the latest segment that took their key away, so it sees the table as it is.
The list of segments is small and lives with its owner, who replaces it last; folders that no list names are garbage.

When FANOUT neighbouring segments of one size class have come together, `compacted` merges them into one: dead rows go, and
so do keys of `gone` unless an older segment is left that they may still concern. A row is rewritten once for each class it
rises through, that is about log4(rows) times in its life.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FANOUT = 4
#: Rows below which all segments are of the least class.
LEAST_ROWS = 1024
#: Keys of `gone` up to here are broadcast; more are joined by key.
BROADCAST_KEYS = 200_000
#: Rows that one task writes in order.
FEW_ROWS = 50_000


@dataclass(frozen=True)
class Segment:
    name: str
    seq: int
    rows: int
    gone: int

    @property
    def size_class(self) -> int:
        return 0 if self.rows <= LEAST_ROWS else 1 + int(math.log(self.rows / LEAST_ROWS, FANOUT))


def joined(segments: list[Segment], folder: str, part: str, spark: SparkSession, schema: str) -> DataFrame:
    """One part of all segments, with the number of its segment in `_seq`."""
    tables = [spark.read.schema(schema).parquet(f"{folder}/{s.name}/{part}").withColumn("_seq", F.lit(s.seq).cast("long")) for s in segments]
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schema).withColumn("_seq", F.lit(0).cast("long"))


def ordered(rows: DataFrame, by: list[str], n: int | None) -> DataFrame:
    """`rows` (about n of them) in order over all files; few rows make one file."""
    return (rows.repartition(1) if n is not None and n <= FEW_ROWS else rows.repartitionByRange(*by)).sortWithinPartitions(*by)


def written(rows: DataFrame, path: str, **options) -> int:
    """Write rows as Parquet; returns their number, counted on the way."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**options).parquet(path)
    return seen.get["n"]


class SegmentedTable:
    """Rows of `schema` that come and go by the column `key`. `sort` orders a segment's rows, so that readers can skip."""

    kind: type[Segment] = Segment

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, segments: list[dict] | None = None, sort: list[str] | None = None):
        self.spark, self.folder, self.schema, self.key, self.sort = spark, folder.rstrip("/"), schema, key, sort or []
        self.segments = [self.kind(**s) for s in segments or []]

    @property
    def columns(self) -> list[str]:
        return [c.strip().split()[0] for c in self.schema.split(", ")]

    @property
    def key_schema(self) -> str:
        return next(c for c in self.schema.split(", ") if c.split()[0] == self.key)

    def listed(self) -> list[dict]:
        return [asdict(s) for s in self.segments]

    def gone(self, segments: list[Segment] | None = None) -> DataFrame:
        """(key, _gone): the latest segment that took the key away."""
        held = [s for s in (self.segments if segments is None else segments) if s.gone]
        return joined(held, self.folder, "gone", self.spark, self.key_schema).groupBy(self.key).agg(F.max("_seq").alias("_gone"))

    def alive(self, rows: DataFrame, segments: list[Segment] | None = None) -> DataFrame:
        """Those of `rows` (with key and _seq) that no later segment took away."""
        segments = self.segments if segments is None else segments
        keys = sum(s.gone for s in segments)
        if not keys:
            return rows
        gone = self.gone(segments)
        gone = F.broadcast(gone) if keys <= BROADCAST_KEYS else gone
        return rows.join(gone, self.key, "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_seq"))).drop("_gone")

    def read(self) -> DataFrame:
        return self.alive(joined(self.segments, self.folder, "rows", self.spark, self.schema)).select(*self.columns)

    def _write_gone(self, name: str, gone: DataFrame | None) -> int:
        if gone is None:
            return 0
        return written(gone.select(self.key).distinct(), f"{self.folder}/{name}/gone")

    def _write(self, rows: DataFrame, gone: DataFrame | None, seq: int, n: int | None = None) -> Segment:
        """`n` tells about how many rows there are, for merges, which put them in order over all files."""
        name = uuid.uuid4().hex
        out = rows.select(*self.columns)
        if self.sort:
            out = out.sortWithinPartitions(*self.sort) if n is None else ordered(out, self.sort, n)
        return Segment(name, seq, written(out, f"{self.folder}/{name}/rows"), self._write_gone(name, gone))

    def _with(self, segments: list[Segment]) -> SegmentedTable:
        out = type(self)(self.spark, self.folder, self.schema, self.key, sort=self.sort)
        out.segments = segments
        return out

    def appended(self, rows: DataFrame, gone: DataFrame | None = None) -> SegmentedTable:
        """The table after a run. Nothing of the older segments is written again."""
        seq = 1 + max((s.seq for s in self.segments), default=0)
        fresh = self._write(rows, gone if self.segments else None, seq)
        return self._with([*self.segments, *([fresh] if fresh.rows or fresh.gone else [])])

    def _due(self) -> list[Segment]:
        """The newest run of FANOUT or more neighbours no larger than the class of its oldest."""
        for low in range(len(self.segments)):
            run = self.segments[low:]
            if len(run) >= FANOUT and max(s.size_class for s in run) <= run[0].size_class and sum(s.size_class == run[0].size_class for s in run) >= FANOUT:
                return run
        return []

    def compacted(self, full: bool = False) -> SegmentedTable:
        """The same rows after merges that are due; `full` leaves one segment."""
        table = self
        while run := (table.segments if full and len(table.segments) > 1 else [] if full else table._due()):
            older = [s for s in table.segments if s not in run]
            rows = table.alive(joined(run, table.folder, "rows", table.spark, table.schema), run)
            gone = table.gone(run) if older else None
            merged = table._write(rows, gone, run[-1].seq, sum(s.rows for s in run))
            table = table._with([*older, *([merged] if merged.rows or merged.gone else [])])
        return table

    def garbage(self, kept: list[Segment]) -> list[str]:
        """Folders of this table's segments that `kept` doesn't name."""
        names = {s.name for s in kept}
        return [f"{self.folder}/{s.name}" for s in self.segments if s.name not in names]
