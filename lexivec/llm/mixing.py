"""Operator 2, mixing sources to target weights: temperature mixing by budgeted block permutations.

Tokens are those of a tokenizer file. Each source's share of all tokens is raised to an exponent between 0 and 1 and
normalised. Entropy falls and the largest repetition falls as the exponent rises, so bisection finds the exponent for a
target entropy, or the least one that keeps every source within a repetition limit; with both given the larger exponent
holds, so that the limit always does. Both measures are sums over sources, taken on the executors for many exponents at
once, so the number of sources has no bound; each pass narrows the bracket to one of GRID parts.

A source with the weight w gets the budget w * B tokens. It is read in epochs: every epoch is a seeded permutation of the
source's blocks (about sqrt(n) seeded groups of documents), each block in a seeded order of its own. Whole epochs come
first, and the last one stops where the budget is used up; the document at that point is still taken. Only block totals
are summed along a source, and documents along a block, so no task grows with a source. Rows that are equal in all columns
are counted first and numbered then, so that no block grows with them either.

Defined results: a null or empty text has no tokens; documents without tokens belong to whole epochs and to the part of the
last one before the budget ends; a null source is a source of its own; a null id counts as an empty one; repeated rows are
separate documents, drawn one by one; two rows that differ in any column (maps apart) are told apart; if no document has
tokens, each comes once; a budget of more epochs than the repetition limit is lowered to it; a text is counted whole,
however long; an empty table gives no rows; other columns are carried along, and new columns give way to theirs in name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .bytetext import slices, tidy
from .shared import Scratch, free_name, materialize, read_table, seeded_key, small_batches, with_copies

SEED = "mix"
#: The bracket of the exponent is cut into GRID parts PASSES times, down to about 2**-48.
GRID, PASSES = 256, 6
CHUNK = 1 << 20
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet. `entropy`: a share of the way from the corpus's own entropy to that of even weights.
    `repetition`: the most epochs of any source. `budget`: tokens to give out, as a multiple of all tokens."""

    entropy: float | None = 0.5
    repetition: float | None = 4.0
    budget: float = 1.0

    @property
    def tokens(self) -> float:
        """The budget that the repetition limit allows; with shares as they are, every source is read so often."""
        return self.budget if self.repetition is None else min(self.budget, self.repetition)


def _measures(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """Of each exponent: sum of weights before normalising, entropy, and the largest weight by share after it."""
    p, a = F.col("share"), F.col("a")
    raised = F.exp(a * F.log(p))
    each = shares.select("share", F.explode(F.lit(exponents)).alias("a"))
    sums = each.groupBy("a").agg(F.sum(raised).alias("z"), F.sum(raised * F.log(p)).alias("l"), F.max(F.exp((a - 1) * F.log(p))).alias("most"))
    return {r.a: (r.z, math.log(r.z) - r.a * r.l / r.z, r.most / r.z) for r in sums.collect()}


def exponent(shares: DataFrame, target: Target) -> tuple[float, float]:
    """(exponent, sum of the raised shares) for a table of the positive `share` of each source."""
    ends = _measures(shares, [0.0, 1.0])
    goal = None if target.entropy is None else ends[1.0][1] + target.entropy * (ends[0.0][1] - ends[1.0][1])

    def too_low(m: tuple[float, float, float]) -> bool:
        """Does an exponent with these measures miss a target that larger ones meet?"""
        return goal is not None and m[1] > goal or target.repetition is not None and m[2] * target.tokens > target.repetition

    if goal is None and target.repetition is None:
        return 1.0, ends[1.0][0]
    if not too_low(ends[0.0]):
        return 0.0, ends[0.0][0]
    low, high, z = 0.0, 1.0, ends[1.0][0]
    for _ in range(PASSES):
        grid = [low + (high - low) * k / GRID for k in range(1, GRID)]
        got = _measures(shares, grid)
        first = next((k for k, a in enumerate(grid) if not too_low(got[a])), len(grid))
        low, (high, z) = grid[first - 1] if first else low, (grid[first], got[grid[first]][0]) if first < len(grid) else (high, z)
    return high, z


def _counted(vocabulary: str, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_ids import encoder

        code = encoder(vocabulary)
        for batch in batches:
            for cut in slices(batch, CHUNK, carried):
                _, counts = code.encode_batch(cut[carried])
                yield pa.RecordBatch.from_arrays([*cut[:carried], pa.array(counts, pa.int64())], names=[*batch.schema.names[:carried], "tokens"])

    return run


def plan(sizes: DataFrame, target: Target) -> DataFrame:
    """(source, n, all_tokens, weight, budget) of each row (source, n, tokens) of `sizes`."""
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    named = sizes.withColumnRenamed("tokens", "all_tokens")
    if not total:
        return named.withColumn("weight", F.lit(0.0)).withColumn("budget", F.lit(0).cast("long"))
    share = F.col("all_tokens") / F.lit(float(total))
    a, z = exponent(named.filter("all_tokens > 0").select(share.alias("share")), target)
    weight = F.when(F.col("all_tokens") > 0, F.exp(F.lit(a) * F.log(share)) / F.lit(z)).otherwise(0.0)
    # Rounded, so that the last bits of sums and powers, which differ between machines, don't move a budget.
    parts = F.round(F.col("weight") * 1e12).cast("decimal(13,0)") * F.lit(round(total * target.tokens)).cast("decimal(18,0)")
    return named.withColumn("weight", weight).withColumn("budget", F.floor((parts + F.lit(5 * 10**11).cast("decimal(13,0)")) / F.lit(10**12).cast("decimal(13,0)")).cast("long"))


def mix(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, vocabulary: str | None = None) -> DataFrame:
    """`docs` as the mixture takes them, a row for each time; new columns `epoch`, `block_rank`, `in_block` and `tokens`
    (or longer names) give the order in a source. `vocabulary` is a file of the tokenizers library."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    scratch = Scratch()
    new = {n: free_name(docs, n) for n in ("epoch", "block_rank", "in_block", "tokens", "_key", "_kept", "_row", "_th")}
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    source, row_id, key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(*hashed)
    counting = docs.select(source.alias("source"), row_id.alias("id"), key.alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    alike = ["source", "id", "th"]
    each = counting.mapInArrow(tidy(_counted(vocabulary, len(alike))), "source string, id string, th long, tokens long")
    counted = scratch.keep(each.groupBy(*alike).agg(F.count("*").alias("times"), F.max("tokens").alias("tokens")), "mix-rows")
    table = scratch.keep(plan(counted.groupBy("source").agg(F.sum("times").alias("n"), F.sum(F.col("tokens") * F.col("times")).alias("tokens")), target), "mix-plan")
    empty = not table.agg(F.max("all_tokens")).first()[0]
    # One row for each source.
    taken = with_copies(counted).join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, "source")
    epochs = F.when(F.lit(empty), 1).when(F.col("budget") <= 0, 0).otherwise(F.ceil(F.col("budget") / F.greatest("all_tokens", F.lit(1))))
    taken = taken.withColumn("epochs", epochs.cast("int")).filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    taken = taken.withColumn("blocks", F.ceil(F.sqrt("n")).cast("long")).withColumn("key", seeded_key(F.lit(seed), F.col("epoch"), F.col("id"), F.col("th"), F.col("copy"))).withColumn("block", F.col("key") % F.col("blocks"))
    block = ["source", "epoch", "block"]
    totals = taken.groupBy(*block).agg(F.sum("tokens").alias("sum")).withColumn("turn", seeded_key(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block")))
    along = Window.partitionBy("source", "epoch").orderBy("turn", "block")
    totals = totals.select(*block, (F.row_number().over(along) - 1).cast("long").alias("block_rank"), (F.sum("sum").over(along) - F.col("sum")).alias("before_block"))
    inside = Window.partitionBy(*block).orderBy("key", "id", "th", "copy")
    counts = taken.withColumn("in_block", (F.row_number().over(inside) - 1).cast("long")).withColumn("before_doc", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    placed = counts.join(totals, block).withColumn("used", F.col("epoch") * F.col("all_tokens") + F.col("before_block") + F.col("before_doc"))
    kept = placed.filter(F.lit(empty) | (F.col("used") < F.col("budget"))).select(*alike, "epoch", "block_rank", "in_block", "tokens")
    kept = kept.select(F.xxhash64(*alike).alias(new["_key"]), F.struct(*alike, "epoch", "block_rank", "in_block", "tokens").alias(new["_kept"]))
    kept = materialize(kept, "mix-kept", "lz4")

    # Equal rows are one row here; `kept` has each time that one of them is taken.
    repeated = counted.filter("times > 1").select(F.xxhash64(*alike).alias(new["_key"])).distinct()
    keyed = docs.withColumn(new["_th"], key).withColumn(new["_key"], F.xxhash64(source, row_id, F.col(new["_th"])))
    if not repeated.isEmpty():
        some = materialize(repeated, "mix-repeated", "lz4")
        side = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        one = keyed.join(side, new["_key"], "left_semi").groupBy(new["_key"], new["_th"], *hashed).agg(*[F.first(F.col(f"`{f.name}`")).alias(f.name) for f in docs.schema if isinstance(f.dataType, MapType)], F.count("*").alias(new["_row"]))
        keyed = keyed.join(side, new["_key"], "left_anti").unionByName(one.select(*keyed.columns))
    scratch.clear()
    kept_col = F.col(new["_kept"])
    same = (source == kept_col["source"]) & (row_id == kept_col["id"]) & (F.col(new["_th"]) == kept_col["th"])
    back = keyed.join(kept, new["_key"]).filter(same)
    return back.select(*(F.col(f"`{c}`") for c in docs.columns), *(kept_col[n].alias(new[n]) for n in ("epoch", "block_rank", "in_block", "tokens")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "epoch", "block_rank", "in_block", "tokens")
