"""Operator 6, n-gram Jaccard join: grouped prefix join on word shingles.

1. Each text becomes a set of 64-bit shingle hashes. Documents with equal sets form one class from here on.
2. A global order of shingles: by hash, but shingles that stand in the prefixes of more than COMMON documents come last.
   At most COMMON_KEPT of these, those with the most documents, are broadcast; the order only saves time, any is right.
3. By the prefix principle, two sets that reach the threshold share a shingle among the first n - ceil(t * n) + 1 of each.
   Classes with identical prefixes and size form one group; groups meet in buckets of shingles, where each bucket counts
   shared prefix shingles. A group pair stays if sizes allow the threshold and shared shingles plus the longer rest of a
   set still reach the overlap that it needs.
4. Group pairs are expanded to members. A bitmap of the parity of a set's shingles in MAP_BITS cells differs between two sets
   in no more places than the sets do, so it rules out nearly all false pairs without loss; the others are verified on
   whole sets. Links are only needed between components that are not
   joined yet, so the best pairs go first and what they join is never compared again: large groups of near copies cost
   about a pair for each member, not all pairs. A shingle with over LONG groups starts with neighbours by size; later its
   members meet where their components still differ.
5. Such long lists, and group pairs whose members are not joined yet, are compared inside tasks: a list is one task, or with
   over BLOCK members blocks of equal size class, of which each pair that can hold a link is a task. A pair is compared in
   the first of its common lists. First the bitmaps tell which members have to be compared at all, then only their sets
   travel, and a task gives out a spanning forest of the links that it finds, never pairs. Members of a list's largest
   component are not compared with each other, so a list with one stray member costs a row for each member.

A shingle in over HOT prefixes is dealt to many tasks, and its list is split like any other.

Sets are told apart by 64 bits; where two different ones agree in them, as a second fingerprint shows, the sets that
clash are named by both together. Tables that are no longer needed are deleted on the way.

Defined results: null texts, and texts without words, have no shingles and link with nothing; equal doc_ids count as one
document, its smallest id standing for the class; a null doc_id is kept, links like any other and is no representative if its component has others;
a text of any length is one set; an empty table gives no rows; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import flat, hashes, mix, multipliers, slices, tidy, tidy_group
from .components import connected_components
from .shared import Scratch, arrow_rows, discard, free_name, materialize, read_table, small_batches

COMMON = 64
COMMON_KEPT = 1 << 17
#: Shingles that a document keeps beyond its prefix, to take the place of common ones.
SPARE = 24
LONG = 32
BROADCAST_ROWS = 400_000
CHUNK = 2 << 20
MAP_BITS = 2048
#: Rows of a batch for Python; one may hold two whole sets.
BATCH_ROWS = 1000
BUCKET_ROWS = 100_000
#: Pairs that a task verifies, at least.
VERIFIED_PAIRS = 4000
#: A shingle that stands in more prefixes is dealt to several tasks.
HOT = 20_000
#: Members of a block of a list, and shingles of their sets, at most (or one member).
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, lengths, words of each text): maximal runs without ASCII white space."""
    gap = _SPACE[raw]
    start = ~gap
    start[1:] &= gap[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = ~gap[heads]
    end = ~gap
    end[:-1] &= gap[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] = ~gap[tails]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, offsets))
    return _LOWER[raw], starts, np.flatnonzero(end) + 1 - starts, counts


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = flat(column)
    lower, starts, lens, counts = words(raw, offsets)
    word = hashes(lower, starts, lens)
    factor = multipliers(size + 1, 7)
    first = np.cumsum(counts) - counts
    joined = np.zeros(len(word), dtype=np.uint64)
    for i in range(size):
        joined[: len(word) - i] += mix(word[i:] * factor[i])
    whole = mix(joined)
    out = []
    for at, n in zip(first.tolist(), counts.tolist()):
        if n >= size:
            one = np.sort(whole[at : at + n - size + 1])
            out.append(one[np.r_[True, one[1:] != one[:-1]]])
        elif n:
            # Fewer words than a shingle: the whole sequence is one.
            some = np.append(mix(word[at : at + n] * factor[:n]), factor[size : size + 1] * np.uint64(n))
            out.append(mix(np.add.reduce(some, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _node(one: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set, as signed numbers."""
    a = np.bitwise_xor.reduce(mix(one + np.uint64(len(one)))) if len(one) else np.uint64(0)
    b = np.add.reduce(mix(one ^ np.uint64(0x5851F42D4C957F2D))) if len(one) else np.uint64(0)
    pair = mix(np.array([a ^ mix(np.array([b]))[0], b], dtype=np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def parity_map(one: np.ndarray) -> bytes:
    return np.packbits(np.bincount((one & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS).astype(np.uint8) & 1).tobytes()


def _maps(column) -> np.ndarray:
    """Rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, MAP_BITS // 64)


def most_different(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles two sets may differ and still reach the threshold."""
    both = na + nb
    return both - 2 * -(-percent * both // (100 + percent))


def _named(sets: list[np.ndarray], bits: int, clash: frozenset[int]) -> list[tuple[int, int]]:
    """(node, check): the names of sets. A node in `clash` stands for several sets, which both fingerprints name together."""
    pairs = [_node(one) for one in sets]
    if bits < 64:
        pairs = [(x & (1 << bits) - 1, y) for x, y in pairs]
    if not clash:
        return pairs
    return [(int(mix(np.array([x], np.int64).view(np.uint64) ^ mix(np.array([y], np.int64).view(np.uint64))).view(np.int64)[0]), y) if x in clash else (x, y) for x, y in pairs]


def _sets(size: int, percent: int, whole: bool, bits: int = 64, clash: frozenset[int] = frozenset()):
    """Rows for `documents`: whole sets, or those of their shingles with the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, th in slices(batch, CHUNK):
                sets = shingle_sets(texts, size)
                nodes = _named(sets, bits, clash)
                kept = sets if whole else [one[: prefix_length(len(one), percent) + SPARE] if len(one) else one for one in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(one) for one in sets], pa.int64()),
                        pa.array([x for x, _ in nodes], pa.int64()),
                        pa.array([y for _, y in nodes], pa.int64()),
                        pa.array([one.tobytes() for one in kept], pa.binary()),
                        pa.array([None if whole else parity_map(one) for one in sets], pa.binary()),
                        th,
                    ],
                    names=["doc_id", "n", "node", "check", "tokens", "map", "th"],
                )

    return run


SETS = "doc_id long, n long, node long, check long, tokens binary, map binary, th long"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all, number of each) of a binary column of 64-bit values."""
    raw, offsets = flat(column.cast(pa.binary()))
    return np.frombuffer(raw.tobytes(), np.uint64), np.diff(offsets) // 8


def _by_bucket(keys: np.ndarray, buckets: int, columns: list[np.ndarray]) -> Iterator[list]:
    """Rows (bucket, packed columns), so that a shuffle moves few and large rows."""
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else [0]
    columns = [c[order] for c in columns]
    for a, b in zip(cut[:-1], cut[1:]):
        yield [int(bucket[a]), *(c[a:b].tobytes() for c in columns)]


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _token_counts(buckets: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = _lists(batch.column(1))
            n = np.asarray(batch.column(0))
            at = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
            token, times = np.unique(values[at < np.repeat(prefix_length(n, percent), counts)], return_counts=True)
            yield _batch(list(_by_bucket(token, buckets, [token, times.astype(np.int32)])), "bucket long, tokens binary, times binary")

    return run


def _gather(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype) for x in table.column(name)]) if table.num_rows else np.zeros(0, dtype)


def _common(limit: int):
    def run(table: pa.Table) -> pa.Table:
        token, times = _gather(table, "tokens", np.uint64), _gather(table, "times", np.int32)
        token, back = np.unique(token, return_inverse=True)
        total = np.bincount(back, weights=times)
        often = total > limit
        return pa.table({"token": pa.array(token[often].view(np.int64)), "times": pa.array(total[often].astype(np.int64))})

    return run


class _Order:
    """Common shingles, found fast: a bitmap of their low bits spares most searches."""

    def __init__(self, common: np.ndarray):
        self.common = np.sort(common)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.common & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def late(self, tokens: np.ndarray) -> np.ndarray:
        out = self.bits[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.common, tokens[maybe]), len(self.common) - 1)
            out[maybe] = self.common[at] == tokens[maybe]
        return out

    def prefix(self, tokens: np.ndarray, n: int, percent: int) -> np.ndarray | None:
        """The first shingles of a set in the order; None if `tokens`, its least ones, don't tell."""
        need = prefix_length(n, percent)
        late = self.late(tokens)
        early = tokens[~late]
        if len(early) >= need:
            return early[:need]
        return None if len(tokens) < n else np.concatenate([early, tokens[late]])[:need]


def _prefixes(common, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(common.value)
        for batch in batches:
            rows = []
            for doc_id, n, node, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                got = order.prefix(np.frombuffer(tokens, np.uint64), n, percent)
                fold = None if got is None else int(mix(np.array([np.bitwise_xor.reduce(mix(got + np.uint64(n)))])).view(np.int64)[0])
                rows.append([doc_id, n, node, fold, None if got is None else got.tobytes()])
            yield _batch(rows, PREFIXES)

    return run


BY_ORDER = ("doc_id", "n", "node", "tokens")
PREFIXES = "doc_id long, n long, node long, fold long, prefix binary"
POSTINGS = "bucket long, tokens binary, groups binary, sizes binary"


def _salted(token: np.ndarray, node: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """What tells the buckets of postings: the shingle, and for hot ones (sorted) also one of so many parts."""
    if not len(hot):
        return token
    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
    is_hot = hot[at] == token
    out = token.copy()
    salt = mix(node[is_hot].view(np.uint64) ^ mix(token[is_hot])) % parts[at[is_hot]]
    out[is_hot] ^= mix(salt + np.uint64(1))
    return out


def _postings(buckets: int, hot: np.ndarray, parts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            token, counts = _lists(batch.column(2))
            node = np.repeat(node, counts)
            yield _batch(list(_by_bucket(_salted(token, node, hot, parts), buckets, [token, node, np.repeat(n, counts).astype(np.int32)])), POSTINGS)

    return run


def _hot_lists(hot: np.ndarray):
    """Rows (list, node, n): the postings of hot shingles, each of which is a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            token, counts = _lists(batch.column(2))
            at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token)
            yield pa.RecordBatch.from_arrays([pa.array(token[at].view(np.int64)), pa.array(np.repeat(node, counts)[at]), pa.array(np.repeat(n, counts)[at].astype(np.int64))], names=["list", "node", "n"])

    return run


def _sized(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small.astype(np.int64) >= percent * large.astype(np.int64)


FOUND = "is_list boolean, a long, b long, n long, long boolean"


def _meet(percent: int, hot: np.ndarray):
    """What the groups of a bucket of shingles have to do with each other.

    Pairs (a, b) that share its shingles, n of them; and lists with over LONG groups, as rows (list, group, size of the
    group). Such a list gives only pairs of neighbours by size, marked `long`. Lists with equal members are one. Of a hot
    shingle only a part is here, so only neighbours come from it.
    """

    def run(table: pa.Table) -> pa.Table:
        token, group, n = _gather(table, "tokens", np.uint64), _gather(table, "groups", np.int64), _gather(table, "sizes", np.int32)
        order = np.lexsort((group, n, token))
        token, group, n = token[order], group[order], n[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])] if len(token) else np.zeros(0, bool)
        token, group, n = token[fresh], group[fresh], n[fresh]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, len(token)])
        is_hot = np.isin(token[first], hot)
        is_long = (length > LONG) | is_hot
        lists, seen = [], set()
        for at, k in zip(first[is_long & ~is_hot].tolist(), length[is_long & ~is_hot].tolist()):
            name = int(mix(np.bitwise_xor.reduce(mix(group[at : at + k].view(np.uint64)), keepdims=True)).view(np.int64)[0])
            if name not in seen:
                seen.add(name)
                lists.append((np.full(k, name), group[at : at + k], n[at : at + k].astype(np.int64)))
        keep = np.repeat(length > 1, length)
        long = np.repeat(is_long, length)[keep]
        token, group, n = token[keep], group[keep], n[keep]
        a, b, far = [], [], []
        for shift in range(1, LONG):
            if shift >= len(token):
                break
            same = token[shift:] == token[:-shift]
            if not same.any():
                break
            at = np.flatnonzero(same & _sized(n[:-shift], n[shift:], percent) & (~long[:-shift] | (shift < 3)))
            a.append(group[at])
            b.append(group[at + shift])
            far.append(long[at])
        a, b, far = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, far))
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        low, high, far = low[order], high[order], far[order].astype(bool)
        head = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(low) else np.zeros(0, np.int64)
        shared = np.diff(np.r_[head, len(low)])
        any_far = np.logical_or.reduceat(far, head) if len(head) else np.zeros(0, bool)
        lists = [np.concatenate(x) for x in zip(*lists)] if lists else [np.zeros(0, np.int64)] * 3
        return pa.table(
            {
                "is_list": pa.array(np.r_[np.zeros(len(head), bool), np.ones(len(lists[0]), bool)]),
                "a": pa.array(np.r_[low[head], lists[0]]),
                "b": pa.array(np.r_[high[head], lists[1]]),
                "n": pa.array(np.r_[shared, lists[2]].astype(np.int64)),
                "long": pa.array(np.r_[any_far, np.zeros(len(lists[0]), bool)]),
            }
        )

    return run


class _Joined:
    """Components by union-find."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def _candidates(table: pa.Table, maps: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places after i, by rising difference of their maps): rows of a task, in order of n, that have to be compared."""
    n, part, block = (np.asarray(table.column(c)) for c in ("n", "part", "block"))
    name, cross = table.column("list")[0].as_py(), table.column("cross")[0].as_py()
    own = [None] * len(n)
    packed = table.column("lists")

    def first_common(i: int, j: int) -> bool:
        for k in (i, j):
            if own[k] is None:
                own[k] = frozenset(packed[k].as_py())
        return min(own[i] & own[j]) == name

    for i in range(len(n)):
        end = int(np.searchsorted(n, 100 * int(n[i]) // percent, side="right"))
        differs = part[i + 1 : end] != part[i]
        if cross:
            differs &= block[i + 1 : end] != block[i]
        at = np.flatnonzero(differs) + i + 1
        if len(at):
            apart = np.bitwise_count(maps[at] ^ maps[i]).sum(axis=1)
            close = apart <= most_different(n[i], n[at], percent)
            at = at[close][np.argsort(apart[close], kind="stable")]
            at = np.array([j for j in at.tolist() if first_common(i, j)], np.int64)
            if len(at):
                yield i, at


TASKS = "task long, list long, node long, n long, part long, block long, cross boolean, lists array<long>"


def _suspects(percent: int):
    """Of the rows of a task those that have to be compared with another one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("node", "ascending")]).combine_chunks()
        wanted = np.zeros(table.num_rows, bool)
        for i, at in _candidates(table, _maps(table.column("map")), percent):
            wanted[i] = True
            wanted[at] = True
        kept = table.select([f.split()[0] for f in TASKS.split(", ")]).filter(pa.array(wanted))
        return kept.set_column(kept.num_columns - 1, "lists", kept.column("lists").cast(pa.list_(pa.int64())))

    return run


def _forest(percent: int):
    """Links (a, b) of a task that join its components, no more than it has rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("node", "ascending")]).combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        node, part = table.column("node").to_pylist(), table.column("part").to_pylist()
        maps = np.frombuffer(b"".join(map(parity_map, sets)), np.uint64).reshape(-1, MAP_BITS // 64)
        joined, a, b = _Joined(), [], []
        for i, at in _candidates(table, maps, percent):
            for j in at.tolist():
                if joined.find(part[i]) != joined.find(part[j]) and _linked(sets[i], sets[j], percent):
                    joined.join(part[i], part[j])
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _tasks(lists: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Rows TASKS of lists (list, node, n) whose members lie in several components; None without any."""
    placed = lists.join(parts.toDF("node", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    each = placed.groupBy("list", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    mixed = each.groupBy("list").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("members"), F.sum("s").alias("shingles")).filter("parts > 1")
    mixed = scratch.keep(mixed.drop("parts"), "mixed-lists")
    if mixed.isEmpty():
        return None
    rows = placed.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed, "list")
    rows = scratch.keep(rows.withColumn("stray", F.col("part") != F.col("main")).drop("main"), "mixed-rows")
    own = rows.groupBy("node").agg(F.collect_set("list").alias("lists"))
    whole = (F.col("members") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    tasks = rows.filter(whole).select(F.col("list").alias("task"), "list", "node", "n", "part", F.lit(0).cast("long").alias("block"), F.lit(False).alias("cross"))
    large = rows.filter(~whole)
    if not large.isEmpty():
        # Two sizes whose ratio allows a link fall into one class or into neighbouring ones.
        large = large.withColumn("class", F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n"))
        cells = large.groupBy("list", "stray", "class").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("m"))
        cells = scratch.keep(cells, "list-cells")
        few = (lambda df: F.broadcast(df)) if cells.count() <= BROADCAST_ROWS else (lambda df: df)
        label = lambda stray, kind, r: F.xxhash64(stray, kind, r)
        placed_in = large.join(few(cells), ["list", "stray", "class"]).withColumn("block", label(F.col("stray"), F.col("class"), F.pmod(F.xxhash64("node"), F.col("m")))).drop("m")
        partner = cells.toDF("list", "stray2", "class2", "m2")
        met = placed_in.join(few(partner), "list").filter((F.abs(F.col("class") - F.col("class2")) <= 1) & (F.col("stray") | F.col("stray2")))
        met = met.withColumn("r2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m2") - 1))).withColumn("block2", label(F.col("stray2"), F.col("class2"), F.col("r2")))
        tasks = tasks.unionByName(
            met.select(F.xxhash64("list", F.least("block", "block2"), F.greatest("block", "block2")).alias("task"), "list", "node", "n", "part", "block", (F.col("block") != F.col("block2")).alias("cross"))
        )
    return tasks.join(own, "node")


def _possible(percent: int):
    """Pairs (with whatever comes after their maps) that the maps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            apart = np.bitwise_count(_maps(batch.column("ma")) ^ _maps(batch.column("mb"))).sum(axis=1)
            keep = pa.array(apart <= most_different(na, nb, percent))
            yield batch.select(["a", "b", "shared"]).filter(keep)

    return run


def _overlaps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def some(rows: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose `column` is (left_semi) or isn't (left_anti) among `ids`, broadcast only when they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, column, how)


def _wide(member: DataFrame, met: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """Lists (list, node, n) of groups and all that they meet, for groups whose members lie in several components or meet
    one that lies elsewhere. A list has the name of its group."""
    held = member.join(parts.toDF("node", "part"), "node", "left").groupBy("group").agg(F.min(F.coalesce("part", "node")).alias("p"), F.max(F.coalesce("part", "node")).alias("q"))
    single = parts.toDF("group", "part")
    pairs = met.select("a", "b").unionByName(held.select(F.col("group").alias("a"), F.col("group").alias("b")))
    for side in "ab":
        pairs = pairs.join(held.toDF(side, f"p{side}", f"q{side}"), side, "left").join(single.toDF(side, "own"), side, "left")
        pairs = pairs.withColumn(f"many_{side}", F.col(f"p{side}").isNotNull()).withColumn(f"p{side}", F.coalesce(f"p{side}", "own", side)).withColumn(f"q{side}", F.coalesce(f"q{side}", "own", side)).drop("own")
    pairs = pairs.filter("(many_a or many_b) and not (pa = qa and pb = qb and pa = pb)").select(F.when(F.col("many_a"), F.col("a")).otherwise(F.col("b")).alias("list"), F.when(F.col("many_a"), F.col("b")).otherwise(F.col("a")).alias("with"))
    heads = pairs.unionByName(pairs.select("list", F.col("list").alias("with"))).distinct()
    each = heads.join(member.toDF("with", "each"), "with", "left").select("list", F.coalesce("each", "with").alias("node"))
    return each.distinct().join(classes.select("node", "n"), "node").select("list", "node", "n")


def jaccard_components(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text", node_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by a Jaccard index of `percent` hundredths or more on word
    shingles of `size` words, and the smallest doc_id that links reach. `node_bits` is less only to test clashes."""
    # All steps with Python run and are written inside; what is returned only joins narrow tables.
    small_batches(docs.sparkSession)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components(docs, size, percent, id_col, text_col, node_bits)


def _components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, node_bits: int, with_hash: bool = False) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    scratch = Scratch()
    keep = scratch.keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    clash: frozenset[int] = frozenset()
    while True:
        rows = materialize(texts.mapInArrow(tidy(_sets(size, percent, False, node_bits, clash)), SETS), "shingles", "lz4")
        classes = materialize(rows.filter("n > 0").groupBy("node", "check", "n").agg(F.min("doc_id").alias("rep")), "classes", "lz4")
        # By chance no two of some billion sets agree in 64 bits; at 10^10 there are a few such pairs.
        more = frozenset(r.node for r in classes.groupBy("node").count().filter("count > 1").select("node").collect())
        if not more:
            break
        discard(rows, classes)
        clash |= more
    scratch.add(rows)
    scratch.add(classes)
    whole_sets = _sets(size, percent, True, node_bits, clash)
    copies = rows.filter("n > 0").select("doc_id", "node").join(classes.select("node", "rep"), "node").filter("doc_id is null or doc_id <> rep").select("doc_id").distinct()
    copies = keep(copies, "copies")
    own = some(rows.filter("n > 0"), "doc_id", copies, "left_anti")
    # A doc_id that has several texts may stand for one class and be a copy in another; its other classes come back here.
    lost = classes.select("node").join(own.select("node").distinct(), "node", "left_anti")
    if not lost.isEmpty():
        own = own.unionByName(rows.join(lost, "node", "left_semi").dropDuplicates(["node"]))

    buckets = max(24, rows.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // (8 * BUCKET_ROWS) + 24
    common = own.select("n", "tokens").mapInArrow(tidy(_token_counts(buckets, percent)), "bucket long, tokens binary, times binary").groupBy("bucket").applyInArrow(tidy_group(_common(COMMON)), "token long, times long")
    often = common.orderBy(F.desc("times"), "token").limit(COMMON_KEPT).collect()
    kept = np.array([r.token for r in often], dtype=np.int64).view(np.uint64)
    # A shingle stands in no more prefixes of the final order than counted here.
    hottest = sorted((r.token & (1 << 64) - 1, -(-r.times // HOT)) for r in often if r.times > HOT)
    hot, hot_parts = np.array([t for t, _ in hottest], np.uint64), np.array([k for _, k in hottest], np.uint64)
    order = spark.sparkContext.broadcast(kept)
    known = keep(own.select(*BY_ORDER).mapInArrow(tidy(_prefixes(order, percent)), PREFIXES), "prefixes")
    unknown = known.filter("prefix is null").select("doc_id").distinct()
    prefixes = known.filter("prefix is not null")
    if not unknown.isEmpty():
        whole = some(texts, "doc_id", unknown, "left_semi")
        if not unknown.filter("doc_id is null").isEmpty():
            whole = whole.unionByName(texts.filter("doc_id is null"))
        whole = whole.mapInArrow(tidy(whole_sets), SETS).filter("n > 0")
        more = whole.select(*BY_ORDER).mapInArrow(tidy(_prefixes(order, percent)), PREFIXES).join(known.filter("prefix is null").select("node").distinct(), "node", "left_semi").select(*prefixes.columns)
        prefixes = prefixes.unionByName(keep(more.dropDuplicates(["node"]), "prefixes"))

    groups = keep(prefixes.groupBy("n", "fold").agg(F.min("node").alias("group"), F.count("*").alias("members")), "groups")
    member = prefixes.select("n", "fold", "node").join(groups.filter("members > 1"), ["n", "fold"]).select("group", "node").distinct()
    member = keep(member, "members")
    heads = some(prefixes, "node", member.filter("node <> group").select("node"), "left_anti")
    postings = heads.select("n", "node", "prefix").mapInArrow(tidy(_postings(buckets, hot, hot_parts)), POSTINGS)
    found = keep(postings.groupBy("bucket").applyInArrow(tidy_group(_meet(percent, hot)), FOUND), "found")
    meetings = found.filter("not is_list").groupBy("a", "b").agg(F.sum("n").alias("shared"), F.max("long").alias("long"))
    sizes = classes.select("node", "n")
    rest = lambda n: F.expr(f"floor({percent} * {n} / 100)")  # noqa: E731  what a set has beyond its prefix, at most
    met = (
        meetings.join(sizes.toDF("a", "na"), "a")
        .join(sizes.toDF("b", "nb"), "b")
        .filter(F.col("long") | (F.col("shared") + F.greatest(rest("na"), rest("nb")) + 1 >= F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))))
    )
    met = keep(met.select("a", "b", "shared"), "meetings")
    lists = found.filter("is_list").select(F.col("a").alias("list"), F.col("b").alias("node"), "n").distinct()
    if len(hot):
        lists = lists.unionByName(heads.select("n", "node", "prefix").mapInArrow(tidy(_hot_lists(hot)), "list long, node long, n long"))
    lists = keep(lists.join(member.toDF("node", "each"), "node", "left").select("list", F.coalesce("each", "node").alias("node"), "n"), "long-lists")

    stars = member.filter("node <> group").select(F.col("group").alias("a"), F.col("node").alias("b"), F.lit(1 << 40).alias("shared"))
    todo = keep(met.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared").groupBy("a", "b").agg(F.max("shared").alias("shared")), "pairs")
    ends = todo.select(F.col("a").alias("node")).union(todo.select("b")).union(lists.select("node")).distinct()
    maps = keep(own.select("node", "n", "map").join(ends, "node").dropDuplicates(["node"]), "maps")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, set): the whole sets of some classes, from a text of each."""
        wanted = keep(nodes.distinct().join(classes, "node").select("node", F.col("rep").alias("doc_id")), "wanted")
        sets = some(texts, "doc_id", wanted.select("doc_id").distinct(), "left_semi").mapInArrow(tidy(whole_sets), SETS)
        bare = wanted.filter("doc_id is null").select("node")
        if not bare.isEmpty():
            # Joins by doc_id never meet null: sets of classes without any id come from all texts without one.
            without = texts.filter("doc_id is null").mapInArrow(tidy(whole_sets), SETS)
            sets = sets.unionByName(without.join(bare, "node", "left_semi").dropDuplicates(["node"]))
        return keep(sets.select("node", F.col("tokens").alias("set")), "sets")

    def possible(pairs: DataFrame) -> DataFrame:
        """(a, b, shared) of the pairs that maps don't rule out."""
        both = pairs.join(maps.toDF("a", "na", "ma"), "a").join(maps.toDF("b", "nb", "mb"), "b")
        return both.select("a", "b", "shared", "na", "nb", "ma", "mb").mapInArrow(tidy(_possible(percent)), "a long, b long, shared long").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return keep(both.mapInArrow(tidy(_overlaps(percent)), "a long, b long, linked boolean").distinct().coalesce(files), "verified")

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs that links found so far don't join."""
        named = pairs.join(parts.toDF("a", "pa"), "a", "left").join(parts.toDF("b", "pb"), "b", "left")
        return named.filter(F.coalesce("pa", "a") != F.coalesce("pb", "b")).drop("pa", "pb")

    possibly = keep(possible(todo), "pairs")
    files = 1 + possibly.count() // VERIFIED_PAIRS
    sets = sets_of(possibly.select(F.col("a").alias("node")).union(possibly.select("b")))
    discard(known, copies, groups, found)
    order.destroy()
    # The best pair of each node first: what it joins need not be compared again.
    best = possibly.select("a", "shared", "b").union(possibly.select(F.col("b").alias("a"), "shared", F.col("a").alias("b"))).groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    checked = verify(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = checked.filter("linked").select("a", "b")
    parts = scratch.add(connected_components(links))
    rest_of = keep(apart(possibly.join(checked.select("a", "b"), ["a", "b"], "left_anti")).select("a", "b").coalesce(files), "rest")
    if not rest_of.isEmpty():
        # All pairs that are known are done before lists are compared: by then most members of a list lie together.
        links = links.unionByName(verify(rest_of).filter("linked").select("a", "b"))
        parts = scratch.add(connected_components(links))
    # Groups with members that the pairs of their heads have not joined, and what these groups meet, make lists too.
    lists = keep(lists.unionByName(_wide(member, met, parts, classes)).distinct(), "all-lists") if not member.isEmpty() else lists
    tasks = _tasks(lists, parts, percent, scratch)
    if tasks is not None:
        suspects = keep(tasks.join(maps.select("node", "map"), "node").groupBy("task").applyInArrow(tidy_group(_suspects(percent)), TASKS), "suspects")
        if not suspects.isEmpty():
            # A node comes twice where a doc_id of it has several texts.
            held = sets_of(suspects.select("node")).join(suspects.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
            links = links.unionByName(keep(suspects.join(held, "node").groupBy("task").applyInArrow(tidy_group(_forest(percent)), "a long, b long"), "late-links"))
            parts = scratch.add(connected_components(links))
    part = classes.join(parts, "node")
    least = part.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = part.join(least, "component").select("node", "component_id")
    answer = classes.select("node", "rep").join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    narrow = rows.select("doc_id", F.col("n").alias("n_shingles"), "node", "th")
    columns = ["doc_id", "n_shingles", "component_id", *["th"] * with_hash]
    out = narrow.filter("n_shingles > 0").join(answer, "node").withColumn("component_id", F.coalesce("component_id", "doc_id")).select(columns)
    out = materialize(out.unionByName(narrow.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(columns)), "jaccard", "lz4")
    scratch.clear()
    return out


def one_of_each(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component: the one whose id is the component's. Rows are told apart by id and text,
    so of two texts under one id only that goes which is a copy; equal rows stay together. Rows without an id go where
    links reach one that has an id, else they stay. Other columns are carried along, whatever their names."""
    small_batches(docs.sparkSession)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        found = _components(docs, size, percent, id_col, text_col, 64, True)
    gone = found.filter("component_id is not null and not (component_id <=> doc_id)").select("doc_id", "th").distinct()
    names = {n: free_name(docs, n) for n in ("_id", "_th")}
    gone = materialize(gone.toDF(*names.values()), "similar", "lz4")
    discard(found)
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, F.col(id_col).cast("long").eqNullSafe(F.col(names["_id"])) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(names["_th"])), "left_anti")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), size=4, percent=85)
