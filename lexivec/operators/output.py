"""Results as JSON, file lists, Markdown or tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def as_files(results: DataFrame) -> DataFrame:
    return results.select(F.col("path").alias("value")).distinct().orderBy("value")


def _place():
    return F.format_string("%s:%d-%d", "path", "start_line", "end_line")


def as_markdown(results: DataFrame) -> DataFrame:
    return results.select(F.concat(F.lit("- `"), _place(), F.lit("` "), F.coalesce("symbol", F.lit("")), F.lit(" — "), F.coalesce("snippet", F.lit(""))).alias("value"))


def as_tsv(results: DataFrame) -> DataFrame:
    return results.select(F.concat_ws("\t", F.format_string("%.4f", "score"), _place(), F.coalesce("symbol", F.lit("")), F.coalesce("snippet", F.lit(""))).alias("value"))
