"""Vector retrieval over an embedding column: exact cosine top-k, representatives, and upkeep of what is embedded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_path, path_prefix
from ..functions.vectors import normalize, similarity

METRICS, QUANTIZATIONS = {"cos"}, {"f32"}


def check_collection(metric: str, quantization: str) -> None:
    if metric.strip().lower() not in METRICS:
        raise ValueError(f"unsupported metric: {metric}")
    if quantization.strip().lower() not in QUANTIZATIONS:
        raise ValueError(f"unsupported quantization: {quantization}")


def top_k(vectors: DataFrame, query: list[float], limit: int, key: str = "content_hash", where=None, digits: int | None = None) -> DataFrame:
    """(key, score) of the nearest vectors. Filters come before the cut, so `limit` rows come back where there are as many."""
    if not query:
        raise ValueError("the query vector is empty")
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    score = similarity(normalize(F.col("vector")), normalize(q))
    score = F.round(score, digits) if digits is not None else score
    return rows.filter(F.size("vector") == len(query)).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def representatives(chunks: DataFrame, languages: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """The first chunk by path and line of each content, among those that pass the filters."""
    rows = chunks.filter(~is_test_path(F.col("path")))
    if languages:
        rows = rows.filter(F.col("language").isin(languages))
    if prefixes:
        rows = rows.filter(path_prefix(F.col("path"), prefixes))
    return rows.groupBy("content_hash").agg(F.min_by("chunk_id", F.struct("path", "start_line", "chunk_id")).alias("chunk_id"), F.min_by("path", F.struct("path", "start_line", "chunk_id")).alias("path"))


def vector_search(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int = 50, languages=None, prefixes=None, digits: int | None = None) -> DataFrame:
    """(chunk_id, path, score): contents ranked by similarity, each shown by its representative."""
    shown = representatives(chunks, languages, prefixes)
    held = vectors.join(shown.select("content_hash"), "content_hash", "left_semi")
    return top_k(held, query, limit, digits=digits).join(shown, "content_hash").select("chunk_id", "path", "score").orderBy(F.desc("score"), "chunk_id")


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Contents that have no vector yet."""
    return chunks.select("content_hash").distinct().join(vectors.select("content_hash"), "content_hash", "left_anti")


def orphans(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors whose content is gone."""
    return vectors.join(chunks.select("content_hash").distinct(), "content_hash", "left_anti")


def embed_texts(chunks: DataFrame, max_chars: int = 8000) -> DataFrame:
    """(content_hash, content): what an embedder gets, each content once by its first chunk, cut to `max_chars` characters."""
    return chunks.groupBy("content_hash").agg(F.substring(F.min_by("content", F.struct("path", "start_line")), 1, max_chars).alias("content"))


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], max_chars: int = 8000, batch: int = 32) -> DataFrame:
    """(content_hash, vector): each content of `chunks` embedded once, cut to `max_chars` characters."""
    todo = embed_texts(chunks, max_chars)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"content_hash": part["content_hash"], "vector": embed(list(part["content"]))})

    return todo.mapInPandas(run, "content_hash string, vector array<double>").select("content_hash", normalize(F.col("vector")).alias("vector"))


def embed_missing(chunks: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], list[list[float]]], max_chars: int = 8000, batch: int = 32) -> DataFrame:
    """Vectors after an incremental run: orphans go, and each new content is embedded once."""
    fresh = embedded(chunks.join(missing(chunks, vectors), "content_hash", "left_semi"), embed, max_chars, batch)
    kept = vectors.join(orphans(chunks, vectors).select("content_hash"), "content_hash", "left_anti")
    return kept.select("content_hash", "vector").unionByName(fresh)


def cosines(rows: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """(chunk_id, score): cosines with the query of the contents of `rows` (chunk_id, content_hash), a few hundred at most."""
    q = normalize(F.array(*[F.lit(float(x)) for x in query]))
    held = vectors.join(F.broadcast(rows), "content_hash").filter(F.size("vector") == len(query))
    return held.select("chunk_id", similarity(normalize(F.col("vector")), q).alias("score"))


def resolve_collection(collections: DataFrame, provider: str, model: str, dim: int | None) -> DataFrame:
    """The collection of the wanted dimension, else the latest one of the provider and model."""
    rows = collections.filter((F.col("provider") == provider) & (F.col("model") == model))
    exact = F.col("dim") == F.lit(dim) if dim is not None else F.lit(False)
    return rows.orderBy(exact.desc(), F.desc("updated_at"), "collection").limit(1)


def wanted_dimension(preferred: int | None, collections: DataFrame, provider: str, model: str, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> int:
    """The preferred dimension, else that of the latest collection, else that of one chunk's vector."""
    if preferred:
        return preferred
    held = resolve_collection(collections, provider, model, None).first()
    if held is not None:
        return held.dim
    first = chunks.orderBy("path", "start_line").select("content").first()
    if first is None:
        raise ValueError("no chunk tells the dimension; index first")
    return len(embed([first.content or ""])[0])


def dropped(collections: DataFrame, vectors: DataFrame, collection) -> tuple[DataFrame, DataFrame]:
    """Both tables without one collection (a column of each)."""
    stays = ~F.col("collection").eqNullSafe(F.lit(collection))
    return collections.filter(stays), vectors.filter(stays)


def counted(vectors: DataFrame) -> DataFrame:
    """(collection, vectors)."""
    return vectors.groupBy("collection").agg(F.count("*").alias("vectors"))


def latest(rows: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """One row for each key, the newest."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def hash_key(content_hash: Column, salt: Column) -> Column:
    """A number below 2**60 for a content, from its hash; with a salt above 0 another one."""
    text = F.when(salt > 0, F.concat_ws("#", content_hash, salt.cast("string"))).otherwise(content_hash)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def surrogate_keys(hashes: DataFrame, key=hash_key) -> DataFrame:
    """(content_hash, key) with one number for each distinct hash. Where two meet at a number, the first by hash keeps it and
    the others try again with a salt; a round looks only at what is left."""
    open_, done, salt = hashes.select("content_hash").distinct(), None, 0
    while True:
        tried = open_.withColumn("key", key(F.col("content_hash"), F.lit(salt)))
        free = tried if done is None else tried.join(done.select("key"), "key", "left_anti").select("content_hash", "key")
        first = free.groupBy("key").agg(F.min("content_hash").alias("content_hash")).select("content_hash", "key")
        done = first if done is None else done.unionByName(first)
        open_ = open_.join(first.select("content_hash"), "content_hash", "left_anti")
        if open_.isEmpty():
            return done
        salt += 1


def keys_of_chunks(chunks: DataFrame, ids: DataFrame, keys: DataFrame) -> DataFrame:
    """(chunk_id, key) of some chunks, by their content."""
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "content_hash").join(keys, "content_hash").select("chunk_id", "key")


def slug(name: str) -> str:
    import re

    return re.sub(r"[^A-Za-z0-9._-]", "_", name) or "collection"
