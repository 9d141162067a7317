"""Operator 13, clustering around centroids of whole numbers with Hamerly's bounds.

Components become floor(256 * x). Each vector keeps its cluster, an upper bound of the distance to its own centroid and one
lower bound of the distance to every other one. When centroids move, the upper bound grows by the move of its own centroid
and the lower one shrinks by the largest move of another. A vector whose upper bound stays below its lower bound, or below
half the way from its centroid to the next, keeps its cluster unseen; else its upper bound is worked out anew, and if that
doesn't settle it, all its distances are, as exact integers. Bounds are widened by SLACK against rounding, and only a strictly
smaller bound settles anything, so ties are always met by a full scan, which takes the smaller number.

Each round writes vectors and bounds to the shared folder; sums of a cluster are partial aggregates, and only the k centroids
come to the driver and go back with the tasks.

Defined results: vectors that are null, have another number of components, a null or non-finite one, or one beyond LARGEST
after scaling (whose squared distances don't fit a long) are left out. Fewer vectors than k give fewer centroids. Repeated
rows, also of one id, are vectors of their own; equal ranks of the start are ordered by components, and a null id comes last.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import tidy
from .shared import discard, materialize, read_table

DIM, K, ROUNDS, UNIT, SEED = 64, 40, 5, 256, 2
#: Whole components up to here in size have squared distances below 2**63, for up to 64 of them.
LARGEST = 1 << 27
SLACK = 1e-9
#: Vectors whose distances are worked out at once.
ROWS = 4096

STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long"


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that can be clustered."""
    scaled = F.transform(vector_col, lambda x: x.cast("double") * UNIT)
    fits = F.forall("x", lambda x: F.abs(x) <= LARGEST)  # not so for NaN and infinity; null for null
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("x")).filter((F.size("x") == dim) & F.coalesce(fits, F.lit(False)))
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of the least hash: a top-k of k rows."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    best = vectors.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(k)
    return np.array([row.v for row in best.collect()], dtype=np.int64)


@dataclass
class Move:
    """Centroids, how far each came from the last round (none at the first), and half the way to its next neighbour."""

    at: np.ndarray
    drift: np.ndarray | None
    half: np.ndarray


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b; a cut of ROWS rows at a time."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for j in range(len(b)):
        d = a - b[j]
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def moved(at: np.ndarray, before: np.ndarray | None) -> Move:
    between = np.sqrt(_between(at, at).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    drift = None if before is None else np.sqrt((((at - before).astype(object)) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
    return Move(at, drift, between.min(axis=1) / 2 * (1 - SLACK))


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, squared distance or -1, vectors scanned in full); `exact` works out every distance."""
    cluster, distance = cluster.copy(), np.full(len(v), -1, dtype=np.int64)
    if move.drift is None:
        upper, lower, open_ = np.full(len(v), np.inf), np.zeros(len(v)), np.arange(len(v))
    else:
        far = int(np.argmax(move.drift))
        others = np.full(len(move.at), move.drift[far])
        others[far] = np.delete(move.drift, far).max(initial=0.0)
        upper, lower = upper + move.drift[cluster], lower - others[cluster]
        settled = np.maximum(lower, move.half[cluster])
        open_ = np.flatnonzero(~(upper < settled))
        d = v[open_] - move.at[cluster[open_]]
        distance[open_] = np.einsum("ij,ij->i", d, d)
        upper[open_] = np.sqrt(distance[open_].astype(np.float64)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < settled[open_])]
    for i in range(0, len(open_), ROWS):
        part = open_[i : i + ROWS]
        every = _between(v[part], move.at)
        nearest = every.argmin(axis=1)
        one = np.arange(len(part))
        cluster[part], distance[part] = nearest, every[one, nearest]
        upper[part] = np.sqrt(distance[part].astype(np.float64)) * (1 + SLACK)
        if every.shape[1] > 1:
            every[one, nearest] = np.iinfo(np.int64).max
            lower[part] = np.sqrt(every.min(axis=1).astype(np.float64)) * (1 - SLACK)
        else:
            lower[part] = np.inf
    if exact:
        unseen = np.flatnonzero(distance < 0)
        d = v[unseen] - move.at[cluster[unseen]]
        distance[unseen] = np.einsum("ij,ij->i", d, d)
    return cluster, upper, lower, distance, len(open_)


def _round(move: Move, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            v = np.asarray(lists.flatten()).astype(np.int64).reshape(batch.num_rows, -1)
            held = [np.asarray(batch.column(i)) for i in (2, 3, 4)]
            cluster, upper, lower, distance, _ = assign(v, *held, move, exact=last)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance)], names=["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return run


def _means(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """Exact floors of the clusters' means; an empty cluster's centroid stays. One row for each cluster comes back."""
    out = at.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", i).cast("long")).alias(f"s{i}") for i in range(at.shape[1])]).collect():
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(at.shape[1])]
    return out


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, upper, lower, distance), centroids) after `rounds` rounds and a last assignment."""
    vectors = whole_vectors(rows, id_col, vector_col, dim)
    at, before = first_centroids(vectors, k), None
    fresh = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    if not len(at):
        return fresh.withColumn("distance", F.lit(0).cast("long")), at
    state = fresh
    for turn in range(rounds + 1):
        step = state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(tidy(_round(moved(at, before), turn == rounds)), STATE)
        following = materialize(step, "clusters")
        if turn:
            discard(state)
        state = following
        if turn < rounds:
            at, before = _means(state, at), at
    return state, at


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, at = cluster(read_table(spark, sf_dir, "embeddings"))
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(at.tolist())]
    # One row for each centroid, k at most.
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    about = sums.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(every))
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    assign_sql = "a{r} AS (SELECT rid, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT, 'k': k}}) AS best FROM kept, c{r} GROUP BY rid)"
    mean_sql = """m{r} AS (SELECT best.k AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN kept USING (rid), range(1, 65) AS t(i) GROUP BY 1, 2),
n{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{r} GROUP BY k),
c{next} AS (SELECT k, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (k))"""
    steps = [f"{assign_sql.format(r=r)},\n{mean_sql.format(r=r, next=r + 1)}" for r in range(rounds)] + [assign_sql.format(r=rounds)]
    return f"""WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 40)),
{(",").join(chr(10) + s for s in steps)}
SELECT vec_id, best.k AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} ON k = best.k"""


OP13_SQL = _sql()
