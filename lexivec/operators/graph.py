"""Symbols and edges from chunks, name resolution, lookups, and root selection."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_path
from . import intervals

# Patterns of edges with their confidence, and words before a bracket that are no calls.
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
#: Edges that a task holds as Python's objects at once.
PIECE_EDGES = 4096
CALL_CONFIDENCE, SELF_CALL_CONFIDENCE = 0.62, 0.45
NOT_CALLS = "if for while switch match return fn func def class struct enum trait impl let new use import from catch throw".split()
IMPORTS = {
    "rust": [r"(?m)^\s*use\s+([A-Za-z0-9_:]+)"],
    "go": [r'(?m)^\s*import\s+(?:\(|)(?:"([^"]+)")'],
    "js": [r"""(?m)^\s*import\s+.*?\s+from\s+["']([^"']+)["']""", r"""require\(\s*["']([^"']+)["']\s*\)"""],
    "python": [r"(?m)^\s*from\s+([A-Za-z0-9_\.]+)\s+import\s+", r"(?m)^\s*import\s+([A-Za-z0-9_\.]+)"],
}
IMPORT_CONFIDENCE = 0.75
ROUTES = [
    (None, r"""(?i)\b(?:router|app|r|e)\.(?:get|post|put|delete|patch|options|head)\s*\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_][A-Za-z0-9_]*)""", 0.86),
    ("go", r"""(?i)\b(?:handlefunc|handle)\s*\(\s*"([^"]+)"\s*,\s*([A-Za-z_][A-Za-z0-9_]*)""", 0.88),
    ("rust", r"""(?i)\broute\s*\(\s*"([^"]+)"\s*,\s*([A-Za-z_][A-Za-z0-9_:]*)""", 0.84),
    ("python", r"""(?m)^\s*@(?:app|router)\.(?:get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", 0.82),
]
SQL = [
    ("sql_read", r"(?i)\bfrom\s+([A-Za-z_][A-Za-z0-9_]*)", 0.77),
    ("sql_read", r"(?i)\bjoin\s+([A-Za-z_][A-Za-z0-9_]*)", 0.77),
    ("sql_read", r"(?i)\bselect\s+.+?\bfrom\s+([A-Za-z_][A-Za-z0-9_]*)", 0.77),
    ("sql_write", r"(?i)\binsert\s+into\s+([A-Za-z_][A-Za-z0-9_]*)", 0.82),
    ("sql_write", r"(?i)\bupdate\s+([A-Za-z_][A-Za-z0-9_]*)", 0.82),
    ("sql_write", r"(?i)\bdelete\s+from\s+([A-Za-z_][A-Za-z0-9_]*)", 0.82),
]
LSP_CONFIDENCE = 0.96

EDGE = "src_symbol_id string, dst_name string, edge_kind string, path string, line long, confidence double, evidence string"


def symbols(chunks: DataFrame) -> DataFrame:
    """One vertex for each chunk with a symbol."""
    short = F.trim("symbol")
    rows = chunks.filter(short != "")
    return rows.select(F.sha2(F.concat_ws(":", F.lit("sym"), "chunk_id", short), 256).alias("symbol_id"), "chunk_id", "path", "start_line", "end_line", "language", "kind", F.concat("path", F.lit("::"), short).alias("fq_name"), short.alias("short_name"))


def line_matches(rows: DataFrame, text: str, pattern: str, keep: list[str], group: int = 1) -> DataFrame:
    """(keep.., line, name, evidence): matches that lie in one line, found without leaving the JVM."""
    lines = rows.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_i", "_line"))
    hits = lines.filter(F.col("_line").rlike(pattern)).select(*keep, (F.col("_i") + 1).cast("long").alias("line"), F.trim("_line").alias("evidence"), F.explode(F.regexp_extract_all("_line", F.lit(pattern), F.lit(group))).alias("name"))
    return hits.select(*keep, "line", "name", "evidence")


def edges(chunks: DataFrame) -> DataFrame:
    """Call, import, route and SQL edges of chunks with symbols. Patterns may cross lines, so whole chunks are searched."""
    import re

    language_of = {"jsx": "js", "ts": "js", "tsx": "js"}

    def of_chunk(sid: str, path: str, language: str, short: str, first: int, text: str) -> Iterator[tuple]:
        lines = text.split("\n")
        family = language_of.get(language, language)

        def edge(kind: str, at: int, name: str, confidence: float, evidence: str | None = None) -> tuple:
            line = text.count("\n", 0, at)
            return sid, name, kind, path, first + line, confidence, lines[line].strip() if evidence is None else evidence

        for m in re.finditer(CALL, text):
            if m[1] not in NOT_CALLS:
                yield edge("call", m.start(1), m[1], SELF_CALL_CONFIDENCE if m[1] == short else CALL_CONFIDENCE)
        for pattern in IMPORTS.get(family, []):
            for m in re.finditer(pattern, text):
                yield edge("import", m.start(1), m[1], IMPORT_CONFIDENCE)
        for only, pattern, confidence in ROUTES:
            if only is None or only == family:
                for m in re.finditer(pattern, text):
                    handler = short if m.re.groups < 2 else m[2].split("::")[-1]
                    yield edge("route", m.start(1), handler, confidence, f"route {m[1]} -> {handler}")
        for kind, pattern, confidence in SQL:
            for m in re.finditer(pattern, text):
                yield edge(kind, m.start(1), m[1], confidence)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EDGE.split(", ")]
        for frame in frames:
            # Edges leave in pieces: what a worker holds depends neither on a batch's rows nor on their edges.
            found = (e for row in frame.itertuples(index=False) for e in of_chunk(*row))
            while piece := list(islice(found, PIECE_EDGES)):
                yield pd.DataFrame(piece, columns=names)

    named = symbols(chunks).select("symbol_id", "chunk_id", "short_name").join(chunks, "chunk_id")
    found = named.select("symbol_id", "path", "language", "short_name", "start_line", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(run, EDGE)
    # The same edge found by two patterns keeps the surer one.
    return found.groupBy("src_symbol_id", "edge_kind", "path", "line", "dst_name", "evidence").agg(F.max("confidence").alias("confidence"))


def resolve(edge_rows: DataFrame, symbol_rows: DataFrame, key: str = "edge_id") -> DataFrame:
    """`edge_rows` with dst_symbol_id: a symbol of that full name, else of that short name, with those of the same path
    first; the first by path and line among equals."""
    open_symbols = symbol_rows.filter(~is_test_path(F.col("path"))).select(F.col("symbol_id").alias("dst"), F.col("path").alias("spath"), F.col("start_line").alias("sline"), "fq_name", "short_name")
    # One candidate for each full name; and for each short name one for each path and one over all paths.
    order = F.struct("spath", "sline", "dst")
    full = open_symbols.groupBy("fq_name").agg(F.min(order).alias("f")).select(F.col("fq_name").alias("dst_name"), F.col("f.dst").alias("by_full"))
    here = open_symbols.groupBy("short_name", "spath").agg(F.min(F.struct("sline", "dst")).alias("h")).select(F.col("short_name").alias("_short"), F.col("spath").alias("path"), F.col("h.dst").alias("by_path"))
    anywhere = open_symbols.groupBy("short_name").agg(F.min(order).alias("a")).select(F.col("short_name").alias("_short"), F.col("a.dst").alias("by_name"))
    short = F.element_at(F.split("dst_name", "::"), -1)
    joined = edge_rows.withColumn("_short", short).join(full, "dst_name", "left").join(here, ["_short", "path"], "left").join(anywhere, "_short", "left")
    return joined.select(*edge_rows.columns, F.coalesce("by_full", "by_path", "by_name").alias("dst_symbol_id"))


def reference_id() -> Column:
    """What tells a reference (columns of EDGE) from all others."""
    return F.sha2(F.concat_ws("\x01", "src_symbol_id", "edge_kind", "path", F.col("line").cast("string"), F.coalesce("dst_name", F.lit("")), F.coalesce("evidence", F.lit(""))), 256)


def last_name(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def touched_references(references: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """References whose target may be another one now: those in `paths`, and those to a name (column name) of a symbol that
    came or went."""
    by_name = references.join(names.select(F.col("name").alias("_name")).distinct(), last_name(F.col("dst_name")) == F.col("_name"), "left_semi")
    return by_name.unionByName(references.join(paths.select("path"), "path", "left_semi")).distinct()


def edge_id(kind: Column | None = None) -> Column:
    return F.sha2(F.concat_ws("\x01", "src_symbol_id", F.coalesce("dst_symbol_id", F.lit("")), F.coalesce("dst_name", F.lit("")), "edge_kind", "path", F.col("line").cast("string"), "evidence"), 256)


def outgoing(edge_rows: DataFrame, most: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Edges with their place among those of their source: surest first, then by line."""
    rows = edge_rows.filter(~is_test_path(F.col("path")))
    rows = rows.filter(F.col("edge_kind").isin(kinds)) if kinds else rows
    order = Window.partitionBy("src_symbol_id").orderBy(F.desc("confidence"), "line", "edge_id")
    ranked = rows.withColumn("edge_rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("edge_rank") <= most) if most else ranked


def with_server_calls(edge_rows: DataFrame, calls: DataFrame, covered: DataFrame) -> DataFrame:
    """Call edges of symbols that a language server knows give way to its own (columns as edges, without confidence)."""
    kept = edge_rows.join(covered.select(F.col("symbol_id").alias("src_symbol_id")).withColumn("edge_kind", F.lit("call")), ["src_symbol_id", "edge_kind"], "left_anti")
    return kept.select(*edge_rows.columns).unionByName(calls.withColumn("confidence", F.lit(LSP_CONFIDENCE)).select(*edge_rows.columns))


def server_worthy(edge_rows: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """Symbols with a call that is resolved or whose name some symbol has: only these are worth asking a server about."""
    calls = edge_rows.filter("edge_kind = 'call'").withColumn("short_name", F.element_at(F.split("dst_name", r"\."), -1))
    known = calls.join(symbol_rows.select("short_name").distinct(), "short_name", "left_semi").select("src_symbol_id")
    return calls.filter("dst_symbol_id is not null").select("src_symbol_id").union(known).distinct().withColumnRenamed("src_symbol_id", "symbol_id")


def covering_symbols(symbol_rows: DataFrame, places: DataFrame) -> DataFrame:
    """Symbols around each (path, line), the narrowest first: each block of lines meets the places in it."""
    around = places.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(intervals.LEVELS - 1)))).withColumn("_block", F.floor(F.col("line") / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    around = around.join(intervals.blocks(symbol_rows, "start_line", "end_line"), ["path", "_level", "_block"]).drop("_level", "_block")
    return around.withColumn("width_rank", F.row_number().over(Window.partitionBy("path", "line").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "symbol_id")).cast("long"))


def symbols_by_id(symbol_rows: DataFrame, ids: list[str]) -> DataFrame:
    return symbol_rows.filter(F.col("symbol_id").isin(ids))


def query_terms(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^A-Za-z0-9_]+", query.lower()) if w]


def roots(hits: DataFrame, symbol_rows: DataFrame, most: int = 20) -> DataFrame:
    """(symbol_id, score): the symbols of hit chunks, each with its best score. A hit without a symbol stands for the narrowest
    one around its first line, where `hits` have a path and start_line. There are a few hundred hits at most."""
    own = hits.select("chunk_id", "score").join(symbol_rows.select("chunk_id", "symbol_id", "path"), "chunk_id").select("symbol_id", "path", "score")
    if {"path", "start_line"} <= set(hits.columns):
        bare = hits.join(symbol_rows.select("chunk_id"), "chunk_id", "left_anti").select("path", F.col("start_line").alias("line"), "score")
        near = symbol_rows.select("path", F.col("start_line").alias("sline"), F.col("end_line").alias("eline"), "symbol_id").join(F.broadcast(bare.select("path").distinct()), "path", "left_semi")
        own = own.unionByName(intervals.narrowest(near, bare, ["path"], "sline", "eline", "line", ["sline", "symbol_id"]).select("symbol_id", "path", "score"))
    best = own.groupBy("symbol_id", "path").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "path", "symbol_id").limit(most)


def fallback_roots(symbol_rows: DataFrame, query: str, most: int = 20) -> DataFrame:
    """Symbols whose short name holds words of the query, half a point for each."""
    score = F.lit(0.0)
    for term in query_terms(query):
        score = score + F.when(F.lower("short_name").contains(term), 0.5).otherwise(0.0)
    return symbol_rows.select("symbol_id", "path", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "path", "symbol_id").limit(most)
