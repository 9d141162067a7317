"""Operator 9, embedding near-dedup: randomised-rotation binary codes with correction factors.

A vector is scaled to length one and turned by random rotations, drawn from a seed. The signs of a turned vector are its
code; with f = <code / sqrt(D), turned vector>, the stored correction factor, <code_x, turned y> / (f * sqrt(D)) estimates
the cosine of x and y without bias, and its error stays within WIDTH * sqrt((1 - f^2) / f^2 / (D - 1)) with a confidence
set by WIDTH. The codes serve twice:

* candidates: `bits` signs under each of several rotations name the buckets in which a vector stands. A pair at the
  threshold agrees in a sign with probability 1 - acos(0.98) / pi, so the number of rotations follows from `bits` and the
  share MISS of such pairs that may meet in no bucket; closer pairs meet more often. `bits` grows with the logarithm of
  the largest label, so buckets keep their size as the input grows.
* decisions: inside a bucket, only pairs whose estimate plus bound reaches the threshold get the exact cosine, in double
  precision; that alone decides.

Vectors with equal label and components are one class throughout. A bucket with over BLOCK vectors is cut into blocks, and
each pair of blocks is a task of its own. A pair counts in the first of its common buckets alone, so link counts need no
list of pairs; a bucket gives a count for each vector and a spanning forest of its links.

Defined results: a row whose vector or label is null, or whose vector is empty, zero or holds null or non-finite numbers,
links with nothing; vectors of different lengths never link; equal vec_ids stay separate rows for counts; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .bytetext import tidy, tidy_group
from .shared import materialize, read_table

THRESHOLD = 0.98
MISS = 0.001
WIDTH = 6.0
BLOCK = 2048
BUCKET = 8
#: Buckets up to SMALL rows are paired side by side; PAIRS of them are compared at a time.
SMALL = 64
PAIRS = 1 << 15
#: Rows of a task, about.
TASK = 20_000
SEED = 20240607


def rotation(dim: int, which: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, which]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a bucket's name, rotations) for a label of `largest` vectors."""
    bits = min(40, max(6, math.ceil(math.log2(max(2, largest) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row's own maximum goes first, so squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as 1 and -1, correction factors) of rows of length one."""
    signs = np.where(turned >= 0, 1.0, -1.0)
    return signs, (signs * turned).sum(axis=1) / math.sqrt(turned.shape[1])


def error_bound(factor: np.ndarray, dim: int) -> np.ndarray:
    """Half the width of the confidence interval of each coded row's estimates."""
    safe = np.maximum(factor, 1e-9)
    return WIDTH * np.sqrt(np.maximum(0, 1 - safe**2) / safe**2 / max(1, dim - 1))


def _names(turned_by: list[np.ndarray], bits: int) -> np.ndarray:
    """The bucket's number under each rotation, a column for each."""
    out = np.empty((len(turned_by[0]), len(turned_by)), dtype=np.int64)
    for i, turned in enumerate(turned_by):
        code = turned[:, : min(bits, turned.shape[1])] >= 0
        out[:, i] = code @ (np.int64(1) << np.arange(code.shape[1], dtype=np.int64))
    return out


def _bucketed(bits: int, rotations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            cls, label = np.asarray(batch.column(0)), batch.column(1)
            vectors = batch.column(2)
            dims = np.asarray(pa.compute.list_value_length(vectors))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                values = unit(np.asarray(vectors.take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, dim))
                turn.setdefault(dim, [rotation(dim, i) for i in range(rotations)])
                names = _names([values @ r.T for r in turn[dim]], bits)
                own = [n.tobytes() for n in names]
                for i in range(rotations):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cls[at]), label.take(pa.array(at)), pa.array(np.full(len(at), dim)), pa.array(np.full(len(at), i)), pa.array(names[:, i]), pa.array(own, pa.binary())],
                        names=["cls", "label", "dim", "turn", "bucket", "names"],
                    )

    return run


BUCKETED = "cls long, label long, dim long, turn long, bucket long, names binary"


def _pairs(cut: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket, some at a time; bucket i holds the rows cut[i] to cut[i + 1]. A bucket that has a right
    side (2) is a pair of blocks and pairs its left rows with these; any other pairs each two rows once."""
    length = np.diff(cut)
    small = np.repeat(length <= SMALL, length) & (side == 0)
    bucket = np.repeat(np.arange(len(length)), length)
    rows = np.arange(len(side))
    for shift in range(1, SMALL):
        x = rows[:-shift][small[:-shift] & (bucket[shift:] == bucket[:-shift])]
        if not len(x):
            break
        for i in range(0, len(x), PAIRS):
            yield x[i : i + PAIRS], x[i : i + PAIRS] + shift
    for at, end in zip(cut[:-1][~small[cut[:-1]]].tolist(), cut[1:][~small[cut[:-1]]].tolist()):
        inside = rows[at:end]
        if (side[at:end] == 0).all():
            for i in inside:
                yield np.full(end - i - 1, i), rows[i + 1 : end]
        else:
            left, right = inside[side[at:end] == 1], inside[side[at:end] == 2]
            for i in left:
                yield np.full(len(right), i), right


def _linked(threshold: float):
    """For many buckets under one rotation: how many links each class has to others there, and a forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        dim, turn = table.column("dim")[0].as_py(), table.column("turn")[0].as_py()
        column = {c: np.asarray(table.column(c)) for c in ("cls", "label", "bucket", "low", "high", "side", "weight")}
        order = np.lexsort([column[c] for c in ("cls", "high", "low", "bucket", "label")])
        cls, side, weight = (column[c][order] for c in ("cls", "side", "weight"))
        vectors = unit(np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim))[order]
        names = np.frombuffer(b"".join(table.column("names").to_pylist()), np.int64).reshape(len(cls), -1)[order]
        change = np.zeros(len(cls), dtype=bool)
        change[0] = True
        for c in ("label", "bucket", "low", "high"):
            ordered = column[c][order]
            change[1:] |= ordered[1:] != ordered[:-1]
        cut = np.append(np.flatnonzero(change), len(cls))
        turned = vectors @ rotation(dim, 0).T
        signs, factor = codes(turned)
        width = error_bound(factor, dim)
        scale = 1 / (np.maximum(factor, 1e-9) * math.sqrt(dim))
        count = np.zeros(len(cls), dtype=np.int64)
        parent = list(range(len(cls)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for x, y in _pairs(cut, side):
            guess = np.einsum("ij,ij->i", signs[x], turned[y]) * scale[x]
            near = guess + width[x] >= threshold
            x, y = x[near], y[near]
            if turn:
                first = ~(names[x, :turn] == names[y, :turn]).any(axis=1)
                x, y = x[first], y[first]
            linked = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= threshold
            x, y = x[linked], y[linked]
            np.add.at(count, x, weight[y])
            np.add.at(count, y, weight[x])
            # Pairs that are joined by now, most of those in a group of near copies, need no step of their own.
            up = np.array(parent)
            apart = up[x] != up[y]
            for s, t in zip(x[apart].tolist(), y[apart].tolist()):
                s, t = root(s), root(t)
                if s != t:
                    parent[max(s, t)] = min(s, t)
        roots = np.array([root(i) for i in range(len(cls))], dtype=np.int64)
        kept = np.flatnonzero((count > 0) | (roots != np.arange(len(cls))))
        return pa.table({"cls": pa.array(cls[kept]), "n": pa.array(count[kept]), "to": pa.array(cls[roots[kept]])})

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of `rows`."""
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), numbers.alias("v")).withColumn("ok", F.coalesce(usable, F.lit(False)))
    # -0.0 and 0.0 are one component; their hashes must be too.
    hashed = F.transform("v", lambda x: x + F.lit(0.0))
    named = materialize(named.withColumn("v", F.when(F.col("ok"), hashed)).withColumn("h", F.xxhash64("label", "v")), "vectors", "lz4")
    classes = named.filter("ok").groupBy("label", "h", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes", "lz4")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, rotations = plan(largest, threshold)

    placed = materialize(classes.select("cls", "label", "v").mapInArrow(tidy(_bucketed(bits, rotations)), BUCKETED).join(classes.select("cls", "weight"), "cls"), "buckets", "lz4")
    key = ["label", "dim", "turn", "bucket"]
    size = placed.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    # A vector of block i goes to the tasks (i, j) with j >= i, as the left side, and (j, i) with j < i, as the right one.
    spread = placed.join(size.drop("size"), key).withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).withColumn("side", F.when(F.col("low") == F.col("high"), 0).when(F.col("block") == F.col("low"), 1).otherwise(2))
    # Small buckets travel together; a pair of blocks is a task by itself.
    tasks = max(1, -(-placed.count() // (TASK * rotations)))
    spread = spread.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label", "bucket"), F.lit(tasks))).otherwise(F.xxhash64("label", "bucket", "low", "high")))
    # Vectors come along only from here on, for what shares its bucket with others.
    spread = spread.join(classes.select("cls", "v"), "cls")
    found = spread.groupBy("dim", "turn", "task").applyInArrow(tidy_group(_linked(threshold)), "cls long, n long, to long")
    found = materialize(found, "vector-links", "lz4")
    count = found.groupBy("cls").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    part = classes.select("cls", "rep").join(parts.toDF("cls", "part"), "cls")
    least = part.groupBy("part").agg(F.min("rep").alias("component_id"))
    answer = classes.select("cls", "label", "h", "v", "rep", "weight").join(count, "cls", "left").join(part.join(least, "part").select("cls", "component_id"), "cls", "left")
    answer = answer.select("label", "h", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = named.filter("ok").join(answer, ["label", "h", "v"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(named.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
