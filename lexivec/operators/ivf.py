"""A vector index of cells: coarse centroids, codes of one byte for each component, and exact vectors by cell.

`cells` has one row for each centroid with the greatest distance of its vectors (radius) and their number. `codes` holds every
unit vector as signed bytes with the length of what rounding took away, `exact` the vectors themselves in one folder for each
cell. A cell of very many vectors is written by several tasks.

A search works with bounds, so it says for certain when its answer is exact. No vector of a cell is nearer to the query than
the distance to the centroid less the radius; cells that can't reach the k-th best score aren't read at all. The codes of
the others give each vector an interval for its score, and only cells with a vector whose interval reaches the k-th best lower
end are opened for exact scores. With `probes` only the nearest cells are read, and `exact` tells whether the bound of every
unread cell lies below the last score.

Centroids are fitted on at most SAMPLE vectors, those of the least hash of their key; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalize, similarity

SAMPLE = 1 << 18
MOST_CELLS = 1 << 14
#: Vectors of a cell that one task writes, about.
PART = 1 << 16
#: Rounding of doubles in bounds and scores.
SLACK = 1e-9
#: Lists of cells that are read to begin with hold this many times the wanted rows.
FIRST = 4


def usable(vectors: DataFrame, key: str = "key") -> DataFrame:
    """(key, unit): vectors of length one. Those that are null, empty or zero, or hold a null or non-finite component, are left out."""
    finite = F.forall("vector", lambda x: F.abs(x.cast("double")) < F.lit(math.inf))  # not so for NaN; null for null
    rows = vectors.filter((F.size("vector") > 0) & F.coalesce(finite, F.lit(False))).select(F.col(key).alias("key"), normalize(F.col("vector")).alias("unit"))
    return rows.filter(F.exists("unit", lambda x: x != 0))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
        scale = np.abs(unit).max(axis=1, keepdims=True) / 127
        code = np.rint(unit / scale).astype(np.int8)
        lost = np.linalg.norm(unit - code * scale, axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale[:, 0]), pa.array(lost + SLACK)], names=["cell", "key", "code", "scale", "lost"])


@dataclass
class Reading:
    """What a search has read: the number of cells by their codes, the cells opened for exact vectors, the number of all."""

    coded_cells: int = 0
    opened: list[int] = field(default_factory=list)
    cells: int = 0


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.cells, self.codes, self.exact = (spark.read.parquet(f"{folder}/{name}") for name in ("cells", "codes", "exact"))

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, key: str = "key", cells: int | None = None, rounds: int = 10) -> VectorIndex:
        """Vectors have one dimension; `cells` is the root of their number unless given."""
        spark = vectors.sparkSession
        unit = usable(vectors, key)
        unit.write.parquet(f"{folder}/unit")
        unit = spark.read.parquet(f"{folder}/unit")
        n = unit.count()
        kind = unit.schema["key"].dataType.simpleString()
        if not n:
            for name, schema in (("cells", "cell int, centroid array<double>, radius double, n long"), ("codes", f"cell int, key {kind}, code binary, scale double, lost double"), ("exact", f"part int, key {kind}, unit array<double>, cell int")):
                spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
            return cls(spark, folder)
        wanted = max(2, min(cells or math.isqrt(n), MOST_CELLS))
        vector = array_to_vector("unit").alias("features")
        sample = unit.select(vector) if n <= SAMPLE else unit.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select(vector)
        model = KMeans(k=wanted, seed=7, maxIter=rounds, featuresCol="features", predictionCol="cell").fit(sample)
        centroids = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        held = spark.createDataFrame(centroids, "cell int, centroid array<double>")  # MOST_CELLS rows at most
        near = model.transform(unit.withColumn("features", array_to_vector("unit"))).select("cell", "key", "unit")
        apart = F.sqrt(F.aggregate(F.zip_with("unit", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        sized = near.join(F.broadcast(held), "cell").groupBy("cell").agg((F.max(apart) + SLACK).alias("radius"), F.count("*").alias("n"))
        sized.join(held, "cell").select("cell", "centroid", "radius", "n").coalesce(1).write.parquet(f"{folder}/cells")
        about = spark.read.parquet(f"{folder}/cells").select("cell", "n")
        part = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / PART)).cast("int")
        dealt = near.join(F.broadcast(about), "cell").select("cell", part.alias("part"), "key", "unit")
        dealt.repartition("cell", "part").write.partitionBy("cell").parquet(f"{folder}/exact")
        coded = near.mapInArrow(_coded, f"cell int, key {kind}, code binary, scale double, lost double")
        coded.repartitionByRange("cell", "key").sortWithinPartitions("cell").write.parquet(f"{folder}/codes")
        return cls(spark, folder)

    def _intervals(self, query: np.ndarray, chosen: list[int]) -> DataFrame:
        """(cell, key, low, high) from the codes of some cells."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(batch.num_rows, -1)
                about = np.einsum("ij,j->i", code, query) * np.asarray(batch.column(3))
                lost = np.asarray(batch.column(4))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(about - lost), pa.array(about + lost)], names=["cell", "key", "low", "high"])

        kind = self.codes.schema["key"].dataType.simpleString()
        return self.codes.filter(F.col("cell").isin(chosen)).mapInArrow(run, f"cell int, key {kind}, low double, high double")

    def bounds(self, query: list[float]) -> list[tuple[int, float, int]]:
        """(cell, highest score that it may hold, vectors), highest first; one short row for each cell comes to the driver."""
        q = F.array(*[F.lit(float(x)) for x in query])
        apart = F.sqrt(F.greatest(F.lit(0.0), dot("centroid", "centroid") + 1 - 2 * dot(F.col("centroid"), q)))
        nearest = F.greatest(F.lit(0.0), apart - F.col("radius"))
        return [tuple(r) for r in self.cells.select("cell", (1 - nearest * nearest / 2 + SLACK).alias("most"), "n").orderBy(F.desc("most"), "cell").collect()]

    def top_k(self, query: list[float], limit: int, probes: int | None = None, digits: int | None = None, reading: Reading | None = None, where: Column | None = None) -> DataFrame:
        """(key, score, exact): the nearest vectors, by score and key. `where` filters keys before the cut."""
        kind = self.codes.schema["key"].dataType.simpleString()
        unit = np.array(query, dtype=np.float64)
        length = float(np.linalg.norm(unit)) if len(unit) else 0.0
        order = self.bounds((unit / length).tolist()) if length else []
        if not order or limit <= 0:
            return self.spark.createDataFrame([], f"key {kind}, score double, exact boolean")
        unit /= length
        margin = 0.0 if digits is None else 10.0**-digits  # rounding before ranking makes ties of near scores
        chosen = order[:probes] if probes else order
        first, rows = [], 0
        for cell, _, n in chosen:
            first.append(cell)
            rows += n
            if rows >= FIRST * limit:
                break
        least = self._kth(unit, first, limit, where)
        cells = [cell for cell, most, _ in chosen if most >= least - margin]
        if set(cells) - set(first):
            least = max(least, self._kth(unit, cells, limit, where))
        intervals = self._intervals(unit, cells).filter(F.col("high") >= least - margin)
        likely = intervals if where is None else intervals.filter(where)
        opened = [r.cell for r in likely.select("cell").distinct().collect()]
        if reading is not None:
            reading.coded_cells, reading.opened, reading.cells = len(cells), opened, len(order)
        vectors = self.exact.filter(F.col("cell").isin(opened)) if opened else self.exact.filter(F.lit(False))
        q = F.array(*[F.lit(float(x)) for x in unit])
        score = similarity(F.col("unit"), q)
        found = vectors.join(likely.select("cell", "key").distinct(), ["cell", "key"], "left_semi").select("key", (F.round(score, digits) if digits is not None else score).alias("score"))
        unread = max((most for _, most, _ in order[len(chosen) :]), default=-2.0)
        best = found.orderBy(F.desc("score"), "key").limit(limit)
        # The last score of `limit` rows, or none where there are fewer.
        last = best.agg(F.when(F.count("*") >= limit, F.min("score")).otherwise(-3.0).alias("last"))
        return best.crossJoin(F.broadcast(last)).select("key", "score", (F.lit(unread) < F.col("last") - margin if unread > -2 else F.lit(True)).alias("exact"))

    def _kth(self, unit: np.ndarray, cells: list[int], limit: int, where: Column | None) -> float:
        """The k-th best lower end among the vectors of some cells; -2 where there are fewer."""
        rows = self._intervals(unit, cells)
        rows = rows if where is None else rows.filter(where)
        held = rows.orderBy(F.desc("low")).limit(limit).agg(F.count("*").alias("n"), F.min("low").alias("low")).first()
        return held.low if held.n >= limit else -2.0
