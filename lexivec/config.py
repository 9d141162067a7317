"""Settings that change results. The defaults equal those of the engine whose results are matched."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class IndexConfig:
    max_file_bytes: int = 2 * 1024 * 1024
    max_chunk_bytes: int = 16 * 1024
    fallback_chunk_lines: int = 200
    fallback_overlap_lines: int = 20


@dataclass(frozen=True)
class EmbedConfig:
    provider: str = "ollama"
    model: str = "nomic-embed-text"
    dimensions: int = 512
    batch_size: int = 32
    max_chars: int = 8000


@dataclass(frozen=True)
class QueryConfig:
    rrf_k: float = 60.0
    bm25_weight: float = 1.0
    vec_weight: float = 1.0
    expansion_bm25_weight: float = 0.6
    limit: int = 50
    bm25_limit: int = 200
    vec_limit: int = 200


@dataclass(frozen=True)
class DeepConfig:
    seed_limit: int = 10
    max_terms: int = 24
    rerank_top: int = 50


@dataclass(frozen=True)
class TraceConfig:
    candidate_roots: int = 20
    beam_fast: int = 32
    beam_deep: int = 64
    hops_fast: int = 4
    hops_deep: int = 8
    limit: int = 5


@dataclass(frozen=True)
class EdgeWeights:
    call: float = 1.0
    route: float = 0.9
    sql_write: float = 0.9
    sql_read: float = 0.8
    import_: float = 0.55
    other: float = 0.4

    def by_kind(self) -> dict[str, float]:
        return {"call": self.call, "route": self.route, "sql_write": self.sql_write, "sql_read": self.sql_read, "import": self.import_}


@dataclass(frozen=True)
class Config:
    index: IndexConfig = field(default_factory=IndexConfig)
    embed: EmbedConfig = field(default_factory=EmbedConfig)
    query: QueryConfig = field(default_factory=QueryConfig)
    deep: DeepConfig = field(default_factory=DeepConfig)
    trace: TraceConfig = field(default_factory=TraceConfig)
    weights: EdgeWeights = field(default_factory=EdgeWeights)


def _read(kind, data: dict):
    known = {f.name.rstrip("_"): f for f in fields(kind)}
    got = {}
    for name, value in data.items():
        if f := known.get(name):
            inner = f.default_factory if isinstance(value, dict) and is_dataclass(f.default_factory) else None
            got[f.name] = _read(inner, value) if inner else value
    return kind(**got)


def load(path: str | Path) -> Config:
    """Settings from a TOML file; what it leaves out keeps its default, and so does everything if there is no file."""
    path = Path(path)
    return _read(Config, tomllib.loads(path.read_text())) if path.exists() else Config()


def _written(value) -> str:
    return json.dumps(value) if isinstance(value, str | bool) else repr(value)


def save(path: str | Path, config: Config) -> None:
    """All settings as TOML, a table for each part; what `load` reads back."""
    parts = []
    for part in fields(config):
        held = getattr(config, part.name)
        parts.append("\n".join([f"[{part.name}]", *(f"{f.name.rstrip('_')} = {_written(getattr(held, f.name))}" for f in fields(held))]))
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n\n".join(parts) + "\n")


def ensure(path: str | Path) -> Config:
    """The settings in a file, which is made of the defaults where there is none."""
    if not Path(path).exists():
        save(path, Config())
    return load(path)
