"""Vectorised work on the UTF-8 bytes of a batch of texts: cutting into pieces, hashing pieces, coding each piece once."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Hand memory that is free here back to the system. Workers live on between tasks, and what they keep for themselves
    an executor has to carry along."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What workers keep between tasks, by the operator that uses it.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The place for what an operator's tasks keep in a worker. What other operators have kept there goes: a worker that turns
    to the next step of a pipeline doesn't carry the vocabularies and caches of the last one along."""
    others = [held for name, held in _KEPT.items() if name != owner and held]
    for held in others:
        held.clear()
    if others:
        give_back()
    return _KEPT.setdefault(owner, {})


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives memory back now and then, and at the end of its task."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, out in enumerate(run(batches)):
            yield out
            if k % 16 == 15:
                give_back()
        give_back()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """The same for applyInArrow, after large groups."""

    @functools.wraps(run)
    def tidied(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > 1 << 20:
            give_back()
        return out

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int = 0) -> np.ndarray:
    """`n` odd pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLDEN) | np.uint64(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, n + 1 offsets). Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, most: int, text: int = 1) -> Iterator[list[pa.Array]]:
    """The columns of `batch`, cut between rows so that a cut holds about `most` bytes of column `text`."""
    _, offsets = flat(batch.column(text))
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield [c.slice(at, end - at) for c in batch.columns]
        at = end


def hashes(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece raw[start : start + len]; the pieces ascend and don't overlap, and none is empty.

    Each byte is multiplied by an odd number for its place in the piece; two different pieces meet with a probability of
    about 2**-56.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int(lens.sum())
    begin = np.cumsum(lens) - lens
    place = np.arange(total, dtype=np.int64) - np.repeat(begin, lens)
    source = raw if total == len(raw) else raw[np.repeat(starts - begin, lens) + np.arange(total, dtype=np.int64)]
    factor = multipliers(int(lens.max()) + 1)
    return mix(np.add.reduceat((source.astype(np.uint64) + np.uint64(1)) * factor[place], begin) + lens.astype(np.uint64) * _GOLDEN)


def ragged(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """pool[start : start + len] of all pieces, one after another."""
    total = int(lens.sum())
    return pool[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total, dtype=np.int64)]


_HEAD = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def heads(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each piece as a number; shorter pieces end in zero bytes."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))[starts]
    return np.ascontiguousarray(eight).view("<u8")[:, 0] & _HEAD[np.minimum(lens, 8)]


class PieceCache:
    """Codes of pieces by their hash, in tables of fixed size: at a clash of slots the newer piece stays, and a full pool
    starts anew. It only saves time; what it returns doesn't depend on what it holds. A hit also has the length and the
    first 8 bytes of its piece, so pieces of up to 8 bytes are told apart for certain."""

    def __init__(self, code: Callable[[list[bytes]], list[np.ndarray]], dtype, slots: int = 1 << 19, pool: int = 1 << 22):
        self.code, self.dtype, self.mask, self.limit = code, dtype, np.uint64(slots - 1), pool
        self.clear()

    def clear(self) -> None:
        n = int(self.mask) + 1
        self.key, self.head = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.size = np.zeros(n, np.int64)  # no piece has the length 0
        self.off = np.zeros(n, np.int32)
        self.len = np.zeros(n, np.int32)
        self.pool = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _append(self, coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        total = int(lens.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), self.dtype)])
        if total:
            self.pool[self.used : self.used + total] = np.concatenate(coded)
        starts = self.used + np.cumsum(lens) - lens
        self.used += total
        return starts, lens

    def lookup(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in self.pool, length) of each piece's codes, good until the next call."""
        if self.used > self.limit:
            self.clear()
        head = heads(raw, starts, lens)
        # Equal keys go on to mean equal pieces within this call, with their first bytes and length in them.
        full = mix(key ^ mix(head + lens.astype(np.uint64)))
        slot = (full & self.mask).astype(np.int64)
        hit = (self.key[slot] == full) & (self.head[slot] == head) & (self.size[slot] == lens)
        off, length = self.off[slot].astype(np.int64), self.len[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        if len(missed):
            fresh, first, back = np.unique(full[missed], return_index=True, return_inverse=True)
            at = missed[first]
            data = raw.tobytes() if len(at) > 1000 else raw
            cut = (lambda s, n: data[s : s + n]) if isinstance(data, bytes) else (lambda s, n: data[s : s + n].tobytes())
            new_off, new_len = self._append(self.code([cut(s, n) for s, n in zip(starts[at].tolist(), lens[at].tolist())]))
            off[missed], length[missed] = new_off[back], new_len[back]
            to = (fresh & self.mask).astype(np.int64)
            self.key[to], self.head[to], self.size[to], self.off[to], self.len[to] = fresh, head[at], lens[at], new_off, new_len
        return off, length
