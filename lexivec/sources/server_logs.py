"""Output of a language server, captured as text lines, parsed with expressions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION = r"^(.+?):(\d+):(\d+)(?:-(?:(\d+):)?(\d+))?"
SYMBOL = r"^(\S+) (\S+) (\d+):(\d+)-(\d+):(\d+)$"
CALL = r"^(caller|callee)\[\d+\]: ranges (\d+):(\d+)-(\d+)(?::(\d+))? in (.+?) from/to (\S+) (\S+) in (.+?):(\d+):(\d+)-(\d+)"


def parse_position(text: str) -> tuple[str, int, int]:
    """`path:line:column`, both counted from 1."""
    m = re.fullmatch(r"(.+):(\d+):(\d+)", text)
    if not m or int(m[2]) < 1 or int(m[3]) < 1:
        raise ValueError(f"expected path:line:column, found {text!r}")
    return m[1], int(m[2]), int(m[3])


def _number(pattern: str, group: int):
    got = F.regexp_extract("value", pattern, group)
    return F.when(got != "", got.cast("long"))


def locations(lines: DataFrame) -> DataFrame:
    """(path, line, column, end_line, end_column) of lines `path:line:column-end`."""
    rows = lines.filter(F.col("value").rlike(LOCATION))
    return rows.select(F.regexp_extract("value", LOCATION, 1).alias("path"), _number(LOCATION, 2).alias("line"), _number(LOCATION, 3).alias("column"), F.coalesce(_number(LOCATION, 4), _number(LOCATION, 2)).alias("end_line"), _number(LOCATION, 5).alias("end_column"))


def document_symbols(lines: DataFrame) -> DataFrame:
    """(name, kind, line, column, end_line, end_column)."""
    text = F.trim("value").alias("value")
    rows = lines.select(text).filter(F.col("value").rlike(SYMBOL))
    return rows.select(F.regexp_extract("value", SYMBOL, 1).alias("name"), F.regexp_extract("value", SYMBOL, 2).alias("kind"), *[_number(SYMBOL, i).alias(n) for i, n in ((3, "line"), (4, "column"), (5, "end_line"), (6, "end_column"))])


def calls(lines: DataFrame) -> DataFrame:
    """(direction, site_path, site_line, kind, name, path, line, column); calls to or from outside files are left out."""
    rows = lines.filter(F.col("value").rlike(CALL))
    out = rows.select(F.regexp_extract("value", CALL, 1).alias("direction"), F.regexp_extract("value", CALL, 6).alias("site_path"), _number(CALL, 2).alias("site_line"), F.regexp_extract("value", CALL, 7).alias("kind"), F.regexp_extract("value", CALL, 8).alias("name"), F.regexp_extract("value", CALL, 9).alias("path"), _number(CALL, 10).alias("line"), _number(CALL, 11).alias("column"))
    outside = F.col("path").startswith("/") | F.col("path").startswith("file://")
    return out.filter(~outside)


def diagnostics(lines: DataFrame) -> DataFrame:
    """(path, line, column, message)."""
    pattern = r"^(.+?):(\d+):(\d+)(?:-[\d:]+)?:\s*(.+)$"
    rows = lines.filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("path"), _number(pattern, 2).alias("line"), _number(pattern, 3).alias("column"), F.regexp_extract("value", pattern, 4).alias("message"))


def identifier_column(line: Column, name: Column) -> Column:
    """The place (bytes, from 1) at which a name first stands in a line as a whole word; null if it doesn't, or is blank."""
    word = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_])"))
    at = F.regexp_instr(line, word)
    return F.when((F.trim(name) != "") & (at > 0), F.octet_length(F.substring(line, F.lit(1), at - 1)) + 1)


def module_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module): the deepest module folder above each file, or none. Each folder above a file meets the modules in an
    equi-join; the empty module is the root."""
    parts = F.split("path", "/")
    above = files.select("path").distinct().withColumn("module", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    found = above.join(modules.select("module").distinct(), "module").groupBy("path").agg(F.max_by("module", F.length("module")).alias("module"))
    return files.select("path").distinct().join(found, "path", "left")
