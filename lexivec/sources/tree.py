"""A directory tree as a table of text files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import paths
from ..session import work_folder

EXCLUDE_FILE = ".git/info/exclude"
HEAD_BYTES, MOST_REPLACED = 8192, 0.10


def repo_root(start: str | Path) -> Path:
    """The nearest folder upwards that holds `.git`, else the start itself."""
    start = Path(start).resolve()
    return next((p for p in (start, *start.parents) if (p / ".git").exists()), start)


def repo_path(root: str | Path, path: str | Path) -> str:
    """The path from the root, with slashes; a path that leaves the root is an error."""
    whole = (Path(root) / path).resolve()
    return whole.relative_to(Path(root).resolve()).as_posix()


def rule_regex(line: str) -> tuple[str, bool, bool] | None:
    """(expression for a path below the rule's folder, it keeps, it is for folders only) of a line of an ignore file."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    keeps, line = line.startswith("!"), line.removeprefix("!")
    folders, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    if not line:
        return None
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        c = line[i]
        if line[i : i + 3] == "**/" and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + len(re.match(r"\*+", line[i:])[0])
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.match(r"\[([!^]?)((?:\\.|[^\]\\])(?:\\.|[^\]\\])*)\]", line[i:])):
            out, i = out + "[" + "^" * bool(m[1]) + m[2].replace("[", "\\[").replace("&", "\\&") + "]", i + m.end()
        else:
            i += c == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    return f"^{out}$", keeps, folders


class Ignore:
    """Patterns of one ignore file at the root, the last match decides; what lies in an ignored folder can't come back."""

    def __init__(self, text: str):
        self.rules = [(re.compile(regex), keeps, folders) for regex, keeps, folders in filter(None, map(rule_regex, text.splitlines()))]

    def ignores(self, path: str) -> bool:
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            entry, out = "/".join(parts[:n]), False
            for rule, keeps, folders in self.rules:
                if (n < len(parts) or not folders) and rule.match(entry):
                    out = not keeps
            if out:
                return True
        return False


RULE = "folder string, place long, regex string, keeps boolean, folders boolean"
#: Rules up to here are broadcast.
BROADCAST_RULES = 100_000


def rules_of(files: DataFrame) -> DataFrame:
    """RULE for the lines of ignore files (path, content). Lines of `.git/info/exclude` count for the root, before all others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                root = path.endswith(EXCLUDE_FILE)
                folder = "" if root else path.rpartition("/")[0]
                for n, line in enumerate((content or "").splitlines()):
                    if rule := rule_regex(line):
                        rows.append((folder, n - (1 << 40) * root, *rule))
            yield pd.DataFrame(rows, columns=["folder", "place", "regex", "keeps", "folders"])

    return files.select("path", "content").mapInPandas(run, RULE)


def ignored(paths_: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of `paths_` (path) that rules leave out.

    Every folder above a path, and the path itself, is an entry; entries meet the rules of each folder above them in an
    equi-join. For each entry the rule of the deepest folder decides, in a folder the last line. A path goes if an entry on
    its way is left out, for nothing in such a folder can come back.
    """
    parts = F.split("path", "/")
    entries = paths_.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("n", "entry"), (F.size(parts) - 1).alias("last"))
    entries = entries.select("path", "entry", (F.col("n") < F.col("last")).alias("is_folder"))
    distinct = entries.select("entry", "is_folder").distinct()
    own = F.split("entry", "/")
    above = distinct.select("entry", "is_folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda n: F.array_join(F.slice(own, F.lit(1), n), "/"))).alias("folder"))
    held = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substring("entry", F.length("folder") + 2, F.length("entry")))
    met = above.join(held, "folder").filter(F.col("is_folder") | ~F.col("folders"))
    met = met.withColumn("below", below).filter(F.expr("below rlike regex"))
    last = met.groupBy("entry", "is_folder").agg(F.max_by("keeps", F.struct(F.length("folder"), "place")).alias("keeps"))
    return entries.join(last.filter("not keeps"), ["entry", "is_folder"]).select("path").distinct()


def is_binary(content: Column) -> Column:
    """A NUL byte, or over a tenth of characters that are no UTF-8, in the first 8 KiB. It stays in the JVM."""
    head = F.substring(content, 1, HEAD_BYTES)
    shown = F.make_valid_utf8(head.cast("string"))
    bad = F.length(shown) - F.length(F.replace(shown, F.lit("\ufffd"), F.lit("")))
    return F.hex(head).rlike("^(?:..)*00") | (bad / F.greatest(F.length(shown), F.lit(1)) > MOST_REPLACED)


def _file_system(root: str):
    """(pyarrow's file system, path) of an address; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


#: Folders that a task lists before it hands on the rest.
FOLDERS = 2000
FOUND = "path string, is_folder boolean, size long, mtime long"


def walk(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, size, mtime) of all files under `root`, hidden ones too, without links. A task goes down from its folders until it
    has listed FOLDERS of them and hands the rest on; these are dealt out anew, round by round, and each round's entries go to
    the shared folder. Excluded folders aren't entered."""
    root, shut = root.rstrip("/"), tuple([*paths.EXCLUDED, *(p.rstrip("/") + "/" for p in exclude or [])])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyarrow import fs

        system, base = _file_system(root)
        local, todo, listed = isinstance(system, fs.LocalFileSystem), [p for frame in frames for p in frame["path"]], 0
        while todo and listed < FOLDERS:
            folder, rows = todo.pop(), []
            listed += 1
            for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
                path = f"{folder}/{info.base_name}" if folder else info.base_name
                if local and os.path.islink(info.path):
                    continue
                if info.type == fs.FileType.File:
                    rows.append((path, False, info.size or 0, (info.mtime_ns or 0) // 10**9))
                elif info.type == fs.FileType.Directory and not f"{path}/".startswith(shut):
                    todo.append(path)
            yield pd.DataFrame(rows, columns=["path", "is_folder", "size", "mtime"])
        yield pd.DataFrame([(p, True, 0, 0) for p in todo], columns=["path", "is_folder", "size", "mtime"])

    place, found = f"{work_folder(spark)}/lexivec/walk-{uuid.uuid4().hex}", []
    frontier = spark.createDataFrame([("",)], "path string").coalesce(1)
    while True:
        frontier.mapInPandas(run, FOUND).write.parquet(f"{place}/{len(found)}")
        found.append(spark.read.schema(FOUND).parquet(f"{place}/{len(found)}"))
        frontier = found[-1].filter("is_folder").select("path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found).filter("not is_folder").drop("is_folder")
        frontier = frontier.repartition("path")


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """`files` (path, ..) with their bytes in `raw`, read where the rows lie; a file that is gone by now is left out."""
    root, schema = root.rstrip("/"), files.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        for frame in frames:
            for at in range(len(frame)):  # one file at a time is held
                try:
                    with system.open_input_stream(f"{base}/{frame['path'].iloc[at]}") as file:
                        raw = file.read()
                except FileNotFoundError:
                    continue
                yield frame.iloc[at : at + 1].assign(raw=[raw])

    return files.mapInPandas(run, f"{schema}, raw binary")


def listing(spark: SparkSession, root: str, config: IndexConfig = IndexConfig(), ignore_text: str = "", exclude: list[str] | None = None) -> DataFrame:
    """(path, size, mtime) of the files under `root` that may be text files, without opening any but ignore files: those named
    `.gitignore` in every folder, and `.git/info/exclude`. `ignore_text` holds further lines for the root, after its own."""
    found = walk(spark, root, exclude)
    path = F.col("path")
    named = found.filter((path == ".gitignore") | path.endswith("/.gitignore")).select("path")
    rules = rules_of(contents(spark, root, named.unionByName(spark.createDataFrame([(EXCLUDE_FILE,)], "path string"))).select("path", F.make_valid_utf8(F.col("raw").cast("string")).alias("content")))
    more = [(("", (1 << 40) + n, *rule)) for n, line in enumerate(ignore_text.splitlines()) if (rule := rule_regex(line))]
    rules = rules.unionByName(spark.createDataFrame(more, RULE))
    rows = found.filter(F.col("size") <= config.max_file_bytes).filter(~paths.is_excluded(path, exclude) & ~paths.is_binary_name(path) & ~paths.is_test_path(path))
    place = f"{work_folder(spark)}/lexivec/rules-{uuid.uuid4().hex}"
    rules.write.parquet(place)  # parsed once, counted, then joined
    return rows.join(ignored(rows.select("path"), spark.read.schema(RULE).parquet(place)), "path", "left_anti").select("path", "size", "mtime")


def scan(spark: SparkSession, root: str, config: IndexConfig = IndexConfig(), ignore_text: str = "", exclude: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime, language, content, content_hash) of the text files under `root`, or of the rows (path, size, mtime)
    in `only`, which a listing gave.

    Hidden files count; ignored, excluded, binary, oversized and test files don't.
    """
    rows = listing(spark, root, config, ignore_text, exclude) if only is None else only.select("path", "size", "mtime")
    rows = contents(spark, root, rows).filter(~is_binary(F.col("raw")))
    content = F.make_valid_utf8(F.col("raw").cast("string"))
    return rows.select("path", "size", "mtime", paths.language(F.col("path")).alias("language"), content.alias("content"), F.sha2(F.col("raw"), 256).alias("content_hash"))


def with_context(chunks: DataFrame, files: DataFrame, before: int = 6, after: int = 6) -> DataFrame:
    """(chunk_id, line, text): a chunk's lines and some around them."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).withColumn("line", (F.col("i") + 1).cast("long"))
    joined = chunks.select("chunk_id", "path", "start_line", "end_line").join(lines, "path")
    return joined.filter(F.col("line").between(F.col("start_line") - before, F.col("end_line") + after)).select("chunk_id", "line", "text")


def batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Frames cut to at most `size` rows, for calls to outside services."""
    for frame in frames:
        for at in range(0, len(frame), size):
            yield frame.iloc[at : at + size]
