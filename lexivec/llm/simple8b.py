"""Word-aligned Simple-8b coding of unsigned integers with numpy.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of payload. The selector says how many values the word
holds and how wide each is; a value over 60 bits is an escape word followed by the value itself. A stream is cut into
blocks of BLOCK values; the word at which each block starts is kept, so that any block decodes alone.
"""

from __future__ import annotations

import numpy as np

# Selector -> (values in a word, bits of each). ESCAPE: the next word is one raw 64-bit value.
LAYOUT = {0: (240, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 1
BLOCK = 1024

_COUNT = np.ones(16, dtype=np.int64)
for _s, (_c, _w) in LAYOUT.items():
    _COUNT[_s] = _c


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 0 for 0."""
    out = np.zeros(values.shape, dtype=np.uint8)
    rest = values.astype(np.uint64, copy=True)
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        out += big.astype(np.uint8) * np.uint8(step)
        rest >>= big.astype(np.uint64) * np.uint64(step)
    return out + (rest > 0).astype(np.uint8)


_BITS16 = bit_lengths(np.arange(1 << 16, dtype=np.uint64))


def _widths(values: np.ndarray) -> np.ndarray:
    return _BITS16[values] if values.dtype == np.uint16 else bit_lengths(values)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place in each block (a row of `bits`, padded with 255), the selector of the word that would start there."""
    largest = {1: bits}

    def of(count: int) -> np.ndarray:
        """Largest width among `count` values from each place on; the rows get shorter on the right."""
        if count not in largest:
            half = count // 2
            a, b = of(count - half), of(half)
            n = bits.shape[1] - count + 1
            largest[count] = np.maximum(a[:, :n], b[:, count - half : count - half + n])
        return largest[count]

    chosen = np.full(bits.shape, ESCAPE, dtype=np.uint8)
    for selector, (count, width) in sorted(LAYOUT.items(), key=lambda x: x[1][0]):
        if count > bits.shape[1] or (width < 4 and not (bits[:, : bits.shape[1]] <= width).any()):
            continue
        fits = of(count) <= width
        np.copyto(chosen[:, : fits.shape[1]], np.uint8(selector), where=fits)
    return chosen


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, start of each block in words uint32). Greedy: each word takes as many values as fit."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    bits = np.full(blocks * BLOCK, 255, dtype=np.uint8)
    bits[:n] = _widths(values)
    selectors = _selectors(bits.reshape(blocks, BLOCK))
    step = _COUNT[selectors]
    base = np.arange(blocks, dtype=np.int64) * BLOCK
    size = np.minimum(n - base, BLOCK)
    rows, flat_step = np.arange(blocks), step.ravel()
    place, starts, owner = np.zeros(blocks, dtype=np.int64), [], []
    while len(rows):  # all blocks advance by a word at a time
        at = base[rows] + place
        starts.append(at)
        owner.append(rows)
        place = place + flat_step[at]
        more = place < size[rows]
        rows, place = rows[more], place[more]
    at, own = np.concatenate(starts), np.concatenate(owner)
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    selector = selectors.ravel()[at]
    long = 1 + (selector == ESCAPE)
    where = np.cumsum(long) - long
    words = np.zeros(int(long.sum()), dtype=np.uint64)
    wide = values.astype(np.uint64, copy=False)
    for s in np.unique(selector):
        picked = np.flatnonzero(selector == s)
        head = np.uint64(int(s) << 60)
        if s == ESCAPE:
            words[where[picked]] = head
            words[where[picked] + 1] = wide[at[picked]]
            continue
        count, width = LAYOUT[int(s)]
        packed = np.full(len(picked), head, dtype=np.uint64)
        for i in range(count if width else 0):
            packed |= wide[at[picked] + i] << np.uint64(i * width)
        words[where[picked]] = packed
    first = np.searchsorted(own, np.arange(blocks))
    return words, where[first].astype(np.uint32)


def decode(words: np.ndarray, n: int, dtype=np.uint64) -> np.ndarray:
    """The first `n` values of a stream of words that starts at a block."""
    out = np.zeros(n, dtype=dtype)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.uint8)
    marked = selector == ESCAPE
    if marked.any():  # in a run of words that look like escapes, every second one is a raw value
        index = np.arange(len(words))
        run_start = np.maximum.accumulate(np.where(marked & ~np.r_[False, marked[:-1]], index, 0))
        escape = marked & ((index - run_start) % 2 == 0)
        raw = np.r_[False, escape[:-1]]
        keep = np.flatnonzero(~raw)
        payload_at = keep + escape[keep]
        selector = np.where(escape[keep], ESCAPE, selector[keep]).astype(np.uint8)
        payload = words[np.minimum(payload_at, len(words) - 1)]
    else:
        payload = words
    count = _COUNT[selector]
    at = np.cumsum(count) - count
    for s in np.unique(selector):
        picked = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[at[picked]] = payload[picked].astype(dtype)
            continue
        each, width = LAYOUT[int(s)]
        if not width:
            continue
        mask = np.uint64((1 << width) - 1)
        part, to = payload[picked], at[picked]
        for i in range(each):
            out[to + i] = ((part >> np.uint64(i * width)) & mask).astype(dtype)
    return out


def decode_span(words: np.ndarray, offsets: np.ndarray, n: int, first: int, last: int, dtype=np.uint64) -> np.ndarray:
    """Values `first` to `last` - 1 of a stream of `n`: only the words of the blocks that hold them are read, all at once."""
    if first >= last:
        return np.zeros(0, dtype=dtype)
    block, after = first // BLOCK, -(-last // BLOCK)
    end = int(offsets[after]) if after < len(offsets) else len(words)
    values = decode(words[int(offsets[block]) : end], min(after * BLOCK, n) - block * BLOCK, dtype)
    return values[first - block * BLOCK : last - block * BLOCK]


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, block: int, dtype=np.uint64) -> np.ndarray:
    """One block of a stream, without touching the others."""
    return decode_span(words, offsets, n, block * BLOCK, min((block + 1) * BLOCK, n), dtype)
