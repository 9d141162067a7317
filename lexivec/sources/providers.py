"""Embedding and scoring services: what the engine asks of them, a local stand-in, and the handling of their answers."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from typing import Protocol

TRIES, FIRST_WAIT, LEAST_BYTES = 3, 0.2, 256


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


class TooLong(Exception):
    """The service says that the input is too long."""


class Passing(Exception):
    """A failure that may pass: too many requests, a server's error, a broken connection."""


def hashed_bag(dim: int = 512) -> Embedder:
    """Lower-case words counted in buckets by the first byte of their digest: offline, and the same everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in re.findall(r"[a-z0-9_]+", text.lower()):
                v[hashlib.sha256(word.encode()).digest()[0] % dim] += 1.0
            out.append(v)
        return out

    return embed


def retried(call: Callable, *args, wait: Callable[[float], None] = time.sleep):
    pause = FIRST_WAIT
    for left in range(TRIES - 1, -1, -1):
        try:
            return call(*args)
        except Passing:
            if not left:
                raise
            wait(pause)
            pause *= 2


def splitting(embed: Embedder) -> Embedder:
    """Halves a batch that is too long, and then a text that is, down to LEAST_BYTES."""

    def run(texts: list[str]) -> list[list[float]]:
        try:
            return embed(texts)
        except TooLong:
            if len(texts) > 1:
                half = len(texts) // 2
                return run(texts[:half]) + run(texts[half:])
            raw = texts[0].encode()
            if len(raw) <= LEAST_BYTES:
                raise
            return run([raw[: max(LEAST_BYTES, len(raw) // 2)].decode("utf-8", "ignore")])

    return run


def vectors_in(answer: str, count: int) -> list[list[float]]:
    """Vectors of an answer in any of the usual forms, in order; a wrong number is an error."""
    data = json.loads(answer)
    if "error" in data:
        raise ValueError(str(data["error"].get("message", data["error"]) if isinstance(data["error"], dict) else data["error"]))
    if "data" in data:
        out = [x["embedding"] for x in sorted(data["data"], key=lambda x: x.get("index", 0))]
    else:
        out = data.get("embeddings") or [data["embedding"]]
    if len(out) != count:
        raise ValueError(f"{len(out)} vectors for {count} texts")
    return [[float(x) for x in v] for v in out]


def scores_in(answer: str, count: int) -> list[float]:
    """Scores by place; a place that the answer leaves out has 0, and an answer without any is an error."""
    data = json.loads(answer)
    out, seen = [0.0] * count, False
    for item in data.get("data") or data.get("results") or []:
        at = item.get("index", item.get("document_index"))
        score = item.get("relevance_score", item.get("score"))
        if isinstance(at, int) and 0 <= at < count and score is not None:
            out[at], seen = float(score), True
    if not seen:
        raise ValueError("the answer holds no score")
    return out


def expansions_in(answer: str, query: str, most: int = 2) -> list[str]:
    """Lines of an answer as queries: without marks and quotes, other than the query itself."""
    out = []
    for line in answer.splitlines():
        line = re.sub(r"^\s*(?:[-*]|\d+[.)])\s*", "", line).strip().strip("\"'`").strip()
        if line and line.lower() != query.strip().lower() and line not in out:
            out.append(line)
    return out[:most]
