"""Operator 3, sharding [native]: proportional stratified interleaving.

Rows of each source are put in a seeded order; the row of rank r among n gets the fraction (r + 1/2) / n; all rows are
sorted by fraction and cut into runs whose lengths differ by one at most (law `rows`). So each shard holds each source in
proportion, to within one row.

No window runs over a whole source: seeded keys fall evenly into about sqrt(n) bins of a source, whose sizes are summed
first, and rows are ranked inside their bin alone. Fractions are even by construction and are binned the same way.

Rows equal in id, text and source are counted first and numbered then, so that the key of each of them is its own; no bin
grows with them, nor with rows that have no id.

Defined results: a null or empty text has size OVERHEAD and checksum 0; a null source is a source of its own, and a null id
counts as an empty one; equal texts, and rows equal in all columns, stay separate rows; a very long text counts by its size
like any other; an empty table gives no rows; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, materialize, read_table, seeded_key, with_copies

SHARDS = 40
OVERHEAD = 16
SEED = "interleave"
KEY_BITS = 60


def _before(sizes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows in the bins before each bin."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return sizes.withColumn("before", F.sum("rows").over(w) - F.col("rows"))


def interleave(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, source, fraction, place, shard, slot), one row for each row of `docs`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scratch = Scratch()
    alike = ["doc_id", "source", "size", "text_crc32"]
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    counted = scratch.keep(slim.groupBy(*alike).agg(F.count("*").alias("times")), "shard-counts")
    rows = scratch.keep(with_copies(counted).withColumn("key", seeded_key(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("copy"))), "shard-rows")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    # One row for each source; sources name feeds or sites, and their number is checked before it is broadcast.
    held = F.broadcast(counts) if counts.count() <= 10_000 else counts
    binned = rows.join(held, "source").withColumn("bins", F.ceil(F.sqrt("n")).cast("long")).withColumn("bin", F.expr(f"cast(floor(key / cast({1 << KEY_BITS} as double) * bins) as long)"))
    sizes = _before(binned.groupBy("source", "bin").agg(F.count("*").alias("rows")), ["source"], "bin").drop("rows")
    in_bin = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "text_crc32", "copy")
    ranked = binned.withColumn("in_bin", F.row_number().over(in_bin) - 1).join(sizes, ["source", "bin"]).withColumn("rank", F.col("before") + F.col("in_bin"))
    total = F.lit(rows.count())
    fraction = materialize(ranked.select("doc_id", "source", "size", "text_crc32", "copy", "key", ((2 * F.col("rank") + 1) / (2 * F.col("n"))).alias("fraction")).withColumn("slice", F.floor(F.col("fraction") * F.ceil(F.sqrt(total))).cast("long")), "shard-fractions")
    slices = _before(fraction.groupBy("slice").agg(F.count("*").alias("rows")), [], "slice").drop("rows")
    in_slice = Window.partitionBy("slice").orderBy("fraction", "source", "key", "doc_id", "size", "text_crc32", "copy")
    placed = fraction.withColumn("in_slice", F.row_number().over(in_slice) - 1).join(slices, "slice").withColumn("place", F.col("before") + F.col("in_slice"))
    scratch.clear()
    shard = F.floor(F.col("place") * shards / total)
    # Division of longs is exact here: place * shards stays far below 2**53 for 10**14 rows.
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("place") - F.ceil(F.col("shard") * total / F.lit(shards))).cast("long")).select("doc_id", "source", "size", "text_crc32", "fraction", "place", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleave(read_table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
