"""Predicates on repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (the second folder is this engine's own): folders at the root that are left out, extensions of binary files, languages by extension.
EXCLUDED = [".git/", ".lexivec/", "target/", "test/", "tests/", "__test__/", "__tests__/", "node_modules/", "dist/", "build/", ".next/", ".turbo/", "vendor/", ".venv/"]
BINARY = "png jpg jpeg gif bmp ico icns pdf zip gz tgz tar 7z rar jar class o a so dylib exe dll wasm mp3 mp4 mov avi mkv".split()
LANGUAGES = {"rs": "rust", "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "py": "python", "go": "go", "md": "markdown", "markdown": "markdown"}

_TEST = "(^|[^a-z0-9])(test|tests|testing)([^a-z0-9]|$)"
_TEST_STEM = "(^|[^a-z0-9])(test|tests|testing|spec|specs)([^a-z0-9]|$)"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    out = F.lit("unknown")
    ext = extension(path)
    for name, lang in LANGUAGES.items():
        out = F.when(ext == name, F.lit(lang)).otherwise(out)
    return out


def is_binary_name(path: Column) -> Column:
    return extension(path).isin(BINARY)


def is_test_path(path: Column) -> Column:
    """A folder with a test word, `.test.` or `.spec.` in the name, or a stem with a test or spec word."""
    low = F.lower(path)
    folder = F.regexp_extract(low, "^(.*)/[^/]*$", 1)
    name = F.regexp_extract(low, "([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return folder.rlike(_TEST) | name.contains(".test.") | name.contains(".spec.") | stem.rlike(_TEST_STEM)


def is_excluded(path: Column, more: list[str] | None = None) -> Column:
    """Prefixes of the path from the root; folders of the same name further down stay."""
    out = F.lit(False)
    for prefix in [*EXCLUDED, *(p.rstrip("/") + "/" for p in more or [])]:
        out = out | path.startswith(prefix)
    return out


def directory(path: Column) -> Column:
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.lit(".")).otherwise(folder)


def path_prefix(path: Column, prefixes: list[str]) -> Column:
    """Any prefix, without regard to case; % and _ stay wildcards."""
    out = F.lit(False)
    for p in prefixes:
        out = out | path.ilike(p + "%")
    return out
