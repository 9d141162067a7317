"""Files to chunks: line windows, Markdown sections, and definitions of source code."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexConfig

CHUNK = "path string, start_line long, end_line long, kind string, symbol string, content string"
HEADING = r"^\s*#{1,6} \s*\S"


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line feed opens no line, and an empty text has none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\z", "")
    return F.when(F.length(text) > 0, F.transform(F.split(body, "\n", -1), lambda s: F.regexp_replace(s, r"\r\z", ""))).otherwise(F.array().cast("array<string>"))


def windows(files: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """(path, start_line, end_line, kind, symbol, content): windows of `size` lines that share `overlap` lines."""
    size = max(1, size)
    step = size - min(overlap, size - 1)
    n = F.size("lines")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)) * step
    rows = files.select("path", lines_of(F.col("content")).alias("lines")).filter(F.size("lines") > 0)
    cut = rows.withColumn("at", F.explode(F.sequence(F.lit(0), last.cast("int"), F.lit(step))))
    return cut.select(
        "path",
        (F.col("at") + 1).cast("long").alias("start_line"),
        F.least(F.col("at") + size, n).cast("long").alias("end_line"),
        F.lit("block").alias("kind"),
        F.lit(None).cast("string").alias("symbol"),
        F.array_join(F.slice("lines", F.col("at") + 1, size), "\n").alias("content"),
    )


def sections(files: DataFrame) -> DataFrame:
    """Markdown files with headings: what stands before the first is the section `Preamble`, the rest run to the next one."""
    rows = files.select("path", F.posexplode(lines_of(F.col("content"))).alias("i", "line"))
    rows = rows.withColumn("head", F.col("line").rlike(HEADING))
    order = Window.partitionBy("path").orderBy("i")
    numbered = rows.withColumn("section", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    title = F.trim(F.regexp_replace(F.col("line"), r"^\s*#{1,6} ", ""))
    grouped = numbered.groupBy("path", "section").agg(
        (F.min("i") + 1).cast("long").alias("start_line"),
        (F.max("i") + 1).cast("long").alias("end_line"),
        F.max(F.when(F.col("head"), title)).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n").alias("content"),
    )
    with_heads = numbered.filter("head").select("path").distinct()
    return grouped.join(with_heads, "path", "left_semi").select("path", "start_line", "end_line", F.lit("md_section").alias("kind"), F.coalesce("title", F.lit("Preamble")).alias("symbol"), "content")


# Heads of definitions. Each is (kind, pattern with the symbol in group 1).
_NAME = r"([A-Za-z_$][\w$]*)"
_JS = [
    ("function", re.compile(rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}", re.M)),
    ("type", re.compile(rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}", re.M)),
    ("function", re.compile(rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+{_NAME}[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)[^=\n]*=>|[A-Za-z_$][\w$]*\s*=>|function\b)", re.M)),
    ("method", re.compile(rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?!(?:if|for|while|switch|catch|return|function|new|else|do)\b){_NAME}\s*\([^;{{}}]*\)[^;{{}}=]*\{{", re.M)),
]
_TS = [*_JS, ("type", re.compile(rf"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+{_NAME}", re.M)), ("type", re.compile(rf"^[ \t]*(?:export\s+)?type\s+{_NAME}[^=\n]*=", re.M)), ("type", re.compile(rf"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}", re.M))]
_RUST_LEAD = r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?"
_RUST = [
    ("function", re.compile(rf"{_RUST_LEAD}(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+{_NAME}", re.M)),
    *(("type", re.compile(rf"{_RUST_LEAD}(?:unsafe\s+)?{word}\s+{_NAME}", re.M)) for word in ("struct", "enum", "trait", "type")),
    ("type", re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b()", re.M)),
    ("const", re.compile(rf"{_RUST_LEAD}(?:const|static)\s+(?:mut\s+)?(?!fn\b|async\b|unsafe\b|extern\b){_NAME}\s*:", re.M)),
    ("module", re.compile(rf"{_RUST_LEAD}mod\s+{_NAME}", re.M)),
]
_GO = [
    ("method", re.compile(rf"^func\s*\([^)]*\)\s*{_NAME}", re.M)),
    ("function", re.compile(rf"^func\s+{_NAME}", re.M)),
    ("type", re.compile(rf"^type\s+{_NAME}\s", re.M)),
]
HEADS = {"rust": _RUST, "go": _GO, "js": _JS, "jsx": _JS, "ts": _TS, "tsx": _TS}
_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n]){1,8}'|`(?:\\.|[^`\\])*`", re.S)


def _blanked(text: str) -> str:
    """The text with comments and strings turned to spaces, so braces inside them don't count."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_SIGNS = re.compile(r"[()\[\]{};\n]")
_GOES_ON = re.compile(r"\s*(?:[{.=|&(:]|where\b|extends\b|implements\b)")


class _Nesting:
    """Brackets of a text without comments and strings, matched in one pass: each opening brace knows its closing one, so a
    definition's body is left in one step."""

    def __init__(self, plain: str):
        self.plain, self.at = plain, [m.start() for m in _SIGNS.finditer(plain)]
        self.close, open_ = {}, []
        for i in self.at:
            if plain[i] == "{":
                open_.append(i)
            elif plain[i] == "}" and open_:
                self.close[open_.pop()] = i

    def end(self, at: int) -> int:
        """Where the definition that begins at `at` ends: its closing brace, or the first semicolon or line end before any
        after which it doesn't go on."""
        plain, round_ = self.plain, 0
        seen, before = "", at  # the last sign but spaces, and the place up to which the head was read
        for k in range(bisect_left(self.at, at), len(self.at)):
            i = self.at[k]
            c, head = plain[i], plain[before:i].rstrip()
            if head.strip():
                seen = head.lstrip()[-2:]
            before = i
            if c == "{":
                return self.close[i] + 1 if i in self.close else len(plain)
            if c == "}":
                return i
            if c in "([":
                round_ += 1
            elif c in ")]":
                round_ -= 1
            elif round_ == 0 and (c == ";" or seen and not _GOES_ON.match(plain, i + 1, i + 200) and not (seen[-1] in ",=(|&:+" or seen == "=>")):
                return i + 1
        return len(plain)


def braced_definitions(text: str, language: str) -> list[tuple[int, int, str, str | None]]:
    """(start line, end line, kind, symbol). In JavaScript and TypeScript what is nested in a function is left out."""
    plain, found = _blanked(text), []
    nesting = _Nesting(plain)
    for kind, head in HEADS[language]:
        for m in head.finditer(plain):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            found.append((at, nesting.end(at), kind, m[1] or None))
    found.sort(key=lambda d: (d[0], -d[1]))
    breaks = [i for i in nesting.at if plain[i] == "\n"]
    line = lambda place: bisect_left(breaks, place) + 1
    out, seen, open_ = [], set(), []  # definitions that are open here, the innermost last
    for d in found:
        at, end, kind, symbol = d
        while open_ and open_[-1][1] <= at:
            open_.pop()
        inside = [o for o in open_ if o[0] < at and end <= o[1]]
        open_.append(d)
        if at in seen:
            continue
        if language in ("js", "jsx", "ts", "tsx") and (any(o[2] in ("function", "method") for o in inside) or kind == "method" and not any(o[2] == "type" for o in inside)):
            continue
        seen.add(at)
        last = end - 1 if end > at and plain[end - 1 : end] == "\n" else end
        out.append((line(at), line(max(at, last)), kind, symbol))
    return out


def python_definitions(text: str) -> list[tuple[int, int, str, str | None]]:
    """Classes and functions; a function in a class is a method, and what is nested in a function is left out."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[int, int, str, str | None]] = []

    def walk(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                out.append((child.lineno, child.end_lineno or child.lineno, "type", child.name))
                walk(child, True)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append((child.lineno, child.end_lineno or child.lineno, "method" if in_class else "function", child.name))
            else:
                walk(child, in_class)

    walk(tree, False)
    return out


def definitions(text: str, language: str) -> list[tuple[int, int, str, str | None]]:
    return python_definitions(text) if language == "python" else braced_definitions(text, language) if language in HEADS else []


def _line_windows(lines: list[str], first: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    step, at = size - min(overlap, size - 1), 0
    while lines:
        yield first + at, first + min(at + size, len(lines)) - 1
        if at + size >= len(lines):
            break
        at += step


def code_chunks(files: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Chunks of the definitions in source files; a definition over the size limit becomes windows that keep its symbol."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, content in zip(frame["path"], frame["language"], frame["content"]):
                lines = (content or "").split("\n")
                for start, end, kind, symbol in definitions(content or "", language):
                    body = "\n".join(lines[start - 1 : end])
                    if len(body.encode()) <= config.max_chunk_bytes:
                        rows.append((path, start, end, kind, symbol, body))
                    else:
                        rows += [(path, a, b, "block", symbol, "\n".join(lines[a - 1 : b])) for a, b in _line_windows(lines[start - 1 : end], start, config.fallback_chunk_lines, config.fallback_overlap_lines)]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "kind", "symbol", "content"])

    return files.filter(F.col("language").isin([*HEADS, "python"])).select("path", "language", "content").mapInPandas(run, CHUNK)


def chunk_id(path: Column, start: Column, end: Column, kind: Column, symbol: Column) -> Column:
    return F.sha2(F.concat_ws("\x01", path, start.cast("string"), end.cast("string"), kind, F.coalesce(symbol, F.lit(""))), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def chunk_files(files: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Chunks of all files by their language; whatever gives none falls back to windows. Identity leaves the content out."""
    special = sections(files.filter("language = 'markdown'")).unionByName(code_chunks(files, config))
    rest = files.join(special.select("path").distinct(), "path", "left_anti")
    every = special.unionByName(windows(rest, config.fallback_chunk_lines, config.fallback_overlap_lines))
    return every.join(files.select("path", "language"), "path").select(chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("kind"), F.col("symbol")).alias("chunk_id"), "path", "language", "start_line", "end_line", "kind", "symbol", content_hash(F.col("content")).alias("content_hash"), "content")
