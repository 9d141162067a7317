"""Fusion of ranked lists, expansion by feedback, and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DeepConfig, QueryConfig
from ..functions.text import identifiers, is_good_term
from . import lexical

SYMBOL_BONUS, PART_WEIGHT = 0.05, 0.2


def ranked(rows: DataFrame) -> DataFrame:
    """(chunk_id, rank) of a list of at most a few hundred scored rows."""
    order = Window.orderBy(F.desc("score"), "chunk_id")
    return rows.select("chunk_id", F.row_number().over(order).cast("long").alias("rank"))


def rrf(lists: list[tuple[float, DataFrame]], k: float = 60.0, digits: int | None = None) -> DataFrame:
    """(chunk_id, score): reciprocal ranks summed over weighted lists (chunk_id, rank)."""
    parts = [rows.select("chunk_id", (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for w, rows in lists if w != 0]
    total = F.sum("part")
    return reduce(DataFrame.unionByName, parts).groupBy("chunk_id").agg((F.round(total, digits) if digits is not None else total).alias("score"))


def prf_terms(seeds: DataFrame, query: str, most: int = 24, content: str = "content", symbol: str | None = None) -> DataFrame:
    """(term, weight): identifiers of the seeds count 1 each, words of symbols 3, identifiers of the query 2."""
    parts = [seeds.select(F.explode(identifiers(F.col(content))).alias("term"), F.lit(1).alias("w"))]
    if symbol:
        words = F.filter(F.split(F.coalesce(F.col(symbol), F.lit("")), "[^A-Za-z0-9_]+"), lambda s: F.length(s) >= 3)
        parts.append(seeds.select(F.explode(words).alias("term"), F.lit(3).alias("w")))
    one = seeds.sparkSession.range(1)
    parts.append(one.select(F.explode(identifiers(F.lit(query))).alias("term"), F.lit(2).alias("w")))
    summed = reduce(DataFrame.unionByName, parts).filter(is_good_term(F.col("term"))).groupBy("term").agg(F.sum("w").alias("weight"))
    return summed.orderBy(F.desc("weight"), "term").limit(most)


def or_query(terms: list[str]) -> str:
    return " OR ".join('"' + t.replace('"', '""') + '"' for t in terms)


def symbol_bonus(symbol: Column, query: str) -> Column:
    import re

    terms = sorted({w.lower() for w in (re.sub(r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "", t) for t in query.split()) if w})
    if not terms:
        return F.lit(0.0)
    parts = F.split(F.lower(F.coalesce(symbol, F.lit(""))), "[^a-z0-9_]+")
    return F.when(F.arrays_overlap(parts, F.array(*[F.lit(t) for t in terms])), F.lit(SYMBOL_BONUS)).otherwise(0.0)


def deterministic_rerank(fused: DataFrame, lexical_rows: DataFrame, similarities: DataFrame, symbols: DataFrame, query: str, top: int = 50, digits: int = 6) -> DataFrame:
    """(chunk_id, score, position). The first `top` rows get shares of both scores and a bonus for symbols; the rest follow."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))
    base = fused.withColumn("place", place).withColumn("tail", F.col("place") > top)
    best = lexical_rows.agg(F.when(F.max("score") > 0, F.max("score")).otherwise(1.0).alias("best"))
    joined = (
        base.join(lexical_rows.select("chunk_id", F.col("score").alias("bm25")), "chunk_id", "left")
        .join(similarities.select("chunk_id", F.col("score").alias("cos")), "chunk_id", "left")
        .join(symbols.select("chunk_id", "symbol"), "chunk_id", "left")
        .crossJoin(F.broadcast(best))  # one row
    )
    head = F.col("score") + PART_WEIGHT * F.coalesce("bm25", F.lit(0.0)) / F.col("best") + PART_WEIGHT * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("cos", F.lit(0.0)))) + symbol_bonus(F.col("symbol"), query)
    new = joined.withColumn("score", F.round(F.when(F.col("tail"), F.col("score")).otherwise(head), digits))
    order = Window.orderBy("tail", F.when(F.col("tail"), F.col("place").cast("double")).otherwise(-F.col("score")), "chunk_id")
    return new.select("chunk_id", "score", F.row_number().over(order).cast("long").alias("position"))


def scored_rerank(fused: DataFrame, contents: DataFrame, scores: DataFrame, top: int = 50) -> DataFrame:
    """(chunk_id, score, position) by an outside scorer's (content_hash, score). Contents without a score come last in the
    head and keep their own."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))
    base = fused.withColumn("place", place).withColumn("tail", F.col("place") > top)
    joined = base.join(contents.select("chunk_id", "content_hash"), "chunk_id", "left").join(scores.select("content_hash", F.col("score").alias("given")), "content_hash", "left")
    given = F.when(~F.col("tail"), F.col("given"))
    order = Window.orderBy("tail", F.desc_nulls_last(given), F.desc("score"), "chunk_id")
    return joined.select("chunk_id", F.coalesce(given, "score").alias("score"), F.row_number().over(order).cast("long").alias("position"))


def unscored(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct contents that the cache has no score for; only these go to the scorer."""
    return candidates.select("content_hash", "content").dropDuplicates(["content_hash"]).join(cache.select("content_hash"), "content_hash", "left_anti")


def held(rows: DataFrame) -> DataFrame:
    """A list of at most a few hundred rows, worked out once; what is built on it doesn't search again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def hybrid(chunks: DataFrame, similarities: DataFrame | None, query: str, config: QueryConfig = QueryConfig(), digits: int | None = None, index: lexical.Index | None = None) -> DataFrame:
    """(chunk_id, score): BM25 and vector lists fused. Without vectors it is BM25 alone."""
    words = ranked(lexical.search(chunks, query, config.bm25_limit, digits=digits, index=index))
    lists = [(config.bm25_weight, words)]
    if similarities is not None:
        lists.append((config.vec_weight, ranked(similarities.orderBy(F.desc("score"), "chunk_id").limit(config.vec_limit))))
    return rrf(lists, config.rrf_k, digits).orderBy(F.desc("score"), "chunk_id").limit(config.limit)


def deep(chunks: DataFrame, similarities: DataFrame | None, query: str, config: QueryConfig = QueryConfig(), settings: DeepConfig = DeepConfig(), expand=None, digits: int | None = None, index: lexical.Index | None = None) -> DataFrame:
    """The hybrid query with expansion: terms of the best chunks, and queries of `expand` if given, add lists of their own.
    At most `max_terms` words come to the driver."""
    first = held(lexical.search(chunks, query, config.bm25_limit, digits=digits, index=index))  # bm25_limit rows at most
    lists = [(config.bm25_weight, ranked(first))]
    if similarities is not None:
        lists.append((config.vec_weight, ranked(similarities.orderBy(F.desc("score"), "chunk_id").limit(config.vec_limit))))
    seeds = first.orderBy(F.desc("score"), "chunk_id").limit(settings.seed_limit).select("chunk_id")
    seeds = chunks.filter(lexical.among("chunk_id", sorted(r.chunk_id for r in seeds.collect())))  # seed_limit ids, by which readers can skip
    terms = [r.term for r in prf_terms(seeds, query, settings.max_terms, symbol="symbol" if "symbol" in chunks.columns else None).collect()]
    if not first.isEmpty():
        more = [or_query(terms)] if terms else []
        asked = [(t, False) for t in more] + [(t, True) for t in (expand(query, terms) if expand else [])]
        for text, literal in asked:
            lists.append((config.expansion_bm25_weight, ranked(lexical.search(chunks, text, config.bm25_limit, literal=literal, digits=digits, index=index))))
    return rrf(lists, config.rrf_k, digits).orderBy(F.desc("score"), "chunk_id").limit(config.limit)
