"""Cleaning and packing a corpus: `documents` goes through STAGES in turn, each written as Parquet and read again.

toxicity       documents that the calibrated trees score at 0.5 or more go
line dedup     repeated runs of two lines or more and repeated long lines go; a document that loses every line goes with them
n-gram join    of documents linked by 5-word shingles at a Jaccard index of 0.8 the one with the smallest id stays
mixing         sources are mixed to target weights; a document comes once for each epoch that takes it
sentencepiece  what is left, as piece ids

All stages but the last return the columns of `documents`, and carry other columns along, whatever their names. Each takes
any DataFrame with doc_id, text and source. Defined results, stage by stage:

* an empty table gives no rows in any stage
* null and empty texts: they score like a text without findings, lose no lines, link with nothing, belong to whole epochs
  of their source, and have no ids
* a null id is carried along; it comes first among places of equal lines; linked to a document that has an id, its row goes
* equal rows are one document: they stay or go together, and each is drawn by itself in the mixture
* two texts under one id are two documents
* a null source is a source of its own
* a very long text is worked on whole; its lines and shingles count like any other's
* ties: of equal lines the one of the smallest id and place stays, of similar documents the one of the smallest id
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import jaccard, line_dedup, mixing, pieces, shared, toxicity

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
REJECT = 0.5

#: The trees and the piece search are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    model = toxicity.fit_contract(docs, shared.read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.filter(scored[scored.columns[-1]] < REJECT).drop(scored.columns[-1])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    removed = out.columns[-1]
    touched = F.col(removed) > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.filter(~(touched & (F.length("text") == 0))).select(*docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared.small_batches(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_similar),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = shared.read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), "stage")
        shared.discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
