"""Operator 11, byte-pair encoding and decoding of words by speculation and verification.

A text becomes words (white space dropped, lower case, contractions, single digits, runs of letters or of other signs), and
every distinct word is encoded once while it is remembered. For the words of a batch that are new, the longest vocabulary
entry at every place is looked up for all places at once; a walk along these entries proposes tokens. A proposal is the
encoding exactly if every two neighbours stay as they are when their joined text is encoded alone. `holds` tests all pairs
of a batch together: two tokens meet along the right edge of the one's merge tree and the left edge of the other's, and the
walk goes back in time, undoing the later merge of the two, until a merge across the border would have come first or only
single bytes are left. Words with a pair that doesn't hold are merged exactly, by the least rank, leftmost of equals.

Plain texts (ASCII and Latin letters whose lower case takes as many bytes) are cut into words on the bytes of a whole batch;
others go through the library's own normaliser and splitter, text by text, and their words go the same way as all. A text
beyond CHUNK bytes is taken in parts that end at white space, and digests of ids and decoded text are carried along.

Decoding joins the entries by single spaces, as the library does for a vocabulary without a decoder.

Defined results: a null or empty text has no ids and decodes to an empty text; a special token's string in a text becomes its
id, as the library does by default; equal rows stay separate; an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import PieceCache, flat, hashes, kept, multipliers, ragged, slices, tidy
from .shared import read_table, small_batches

CHUNK = 1 << 20
#: Words of more bytes are walked one by one, not step by step with all others.
LONG_WORD = 256
LETTER, DIGIT, SPACE, SIGN, UNSURE = range(5)
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def _plain_classes() -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, class of each character of two bytes below U+0250 by its number)."""
    one = np.full(256, UNSURE, dtype=np.uint8)
    for c in range(0x20, 0x7F):
        one[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN
    one[[9, 10, 13, 32]] = SPACE
    two = np.full(0x250, UNSURE, dtype=np.uint8)
    for c in range(0xA1, 0x250):
        kind = unicodedata.category(chr(c))
        if kind[0] in "PS":
            two[c] = SIGN
        elif kind[0] == "L" and len(chr(c).lower()) == 1 and 0x80 <= ord(chr(c).lower()) < 0x800:
            two[c] = LETTER
    return one, two


_ONE, _TWO = _plain_classes()
_LOWER_ONE = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_LOWER_TWO = np.array([ord(chr(c).lower()) if _TWO[c] == LETTER else c for c in range(0x250)], dtype=np.int64)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, lengths, text is unsure) of the words into which plain texts fall."""
    kind = _ONE[raw]
    low = _LOWER_ONE[raw]
    lead = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC9))
    lead = lead[lead + 1 < len(raw)]
    code = (raw[lead].astype(np.int64) & 0x1F) << 6 | (raw[lead + 1] & 0x3F)
    kind[lead] = kind[lead + 1] = _TWO[code]
    lower = _LOWER_TWO[code]
    low[lead], low[lead + 1] = 0xC0 | lower >> 6, 0x80 | lower & 0x3F
    tail = np.zeros(len(raw), dtype=bool)
    tail[lead + 1] = True
    unsure = np.zeros(len(offsets) - 1, dtype=bool)
    unsure[np.searchsorted(offsets, np.flatnonzero(kind == UNSURE), side="right") - 1] = True
    start = np.ones(len(raw), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == DIGIT
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    start[offsets[:-1][offsets[:-1] < len(raw)]] = True
    start &= ~tail
    quote = np.flatnonzero((raw == 0x27) & start)
    if len(quote):
        padded = np.concatenate([low, np.zeros(2, np.uint8)])
        cut = np.concatenate([edge, np.ones(2, dtype=bool)])
        open_ = ~cut[quote + 1]
        for ending in CONTRACTIONS:
            hit = open_.copy()
            for k, c in enumerate(ending):
                hit &= (padded[quote + 1 + k] == c) & ~cut[quote + 1 + k]
            at = quote[hit]
            start[at + 1] = False
            after = at + 1 + len(ending)
            start[after[after < len(raw)]] = True
    # A start may have fallen on white space or on the second byte of a character; neither begins a word.
    starts = np.flatnonzero(start & ~tail)
    lens = np.diff(np.append(starts, len(raw)))
    word = kind[starts] != SPACE
    return low, starts[word], lens[word], unsure


class Vocabulary:
    """Entries, merges and their trees of a word-wise byte-pair tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        model = about["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout") or about["decoder"]:
            raise ValueError("only byte-pair files with the word end </w>, without a decoder, are read")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in about["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.middle_byte = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.end_byte = np.array([vocab[c + "</w>"] for c in letters], dtype=np.int64)
        self.left, self.right = (np.full(self.size, -1, dtype=np.int64) for _ in range(2))
        self.rank = np.full(self.size, -1, dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first, second, made = (np.array(x, dtype=np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]))
        order = np.arange(len(merges))
        self.left[made], self.right[made], self.rank[made] = first, second, order
        if len(set(made.tolist())) < len(made) or (np.maximum(self.rank[first], self.rank[second]) >= order).any():
            raise ValueError("merges have to make distinct entries from earlier ones")
        sort = np.argsort(first * self.size + second)
        self.pair_key, self.pair_made = (first * self.size + second)[sort], made[sort]
        self.pairs = dict(zip(zip(first.tolist(), second.tolist()), made.tolist()))
        self._trie(vocab)
        surface = [b""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            surface[i] = text.encode() + b" "
        size = np.array([len(s) for s in surface], dtype=np.int64)
        self.surface, self.surface_at, self.surface_len = np.frombuffer(b"".join(surface), np.uint8), np.cumsum(size) - size, size
        self.exact = self.encoded = 0  # words merged exactly, words encoded
        self.cache = PieceCache(self._code, np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4"))

    def _trie(self, vocab: dict[str, int]) -> None:
        """Beginnings of entries by a rolling hash, with the entry that ends there, in and at the end of a word."""
        plain = {}
        for text, i in vocab.items():
            ends = text.endswith("</w>") and len(text) > 4
            plain[i] = bytes(self.byte_of[c] for c in (text[:-4] if ends else text)), ends
        self.length = np.zeros(self.size, dtype=np.int64)
        for i, (raw, _) in plain.items():
            self.length[i] = len(raw)
        self.longest = int(self.length.max())
        self.factor = multipliers(self.longest, seed=11)
        ids = np.array(sorted(plain, key=lambda i: len(plain[i][0])), dtype=np.int64)
        data = np.frombuffer(b"".join(plain[i][0] for i in ids.tolist()), np.uint8)
        at = np.cumsum(self.length[ids]) - self.length[ids]
        self.entry_raw, self.entry_at = data, np.zeros(self.size, dtype=np.int64)
        self.entry_at[ids] = at
        ends = np.array([plain[i][1] for i in ids.tolist()])
        held: dict[int, list[int]] = {}
        state = np.zeros(len(ids), dtype=np.uint64)
        for k in range(self.longest):
            live = np.flatnonzero(self.length[ids] > k)
            state[live] += (data[at[live] + k].astype(np.uint64) + np.uint64(1)) * self.factor[k]
            for j, h in zip(live.tolist(), state[live].tolist()):
                slot = held.setdefault(h, [-1, -1])
                if self.length[ids[j]] == k + 1:
                    slot[int(ends[j])] = int(ids[j])
        self.trie = np.array(sorted(held), dtype=np.uint64)
        self.trie_id = np.array([held[h] for h in self.trie.tolist()], dtype=np.int64)

    def longest_entries(self, raw: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The longest entry that begins at each place; `left` is the number of bytes to the end of its word."""
        best = np.where(left == 1, self.end_byte[raw], self.middle_byte[raw])
        live, state = np.arange(len(raw)), np.zeros(len(raw), dtype=np.uint64)
        for k in range(self.longest):
            stay = left[live] > k
            live, state = live[stay], state[stay]
            state = state + (raw[live + k].astype(np.uint64) + np.uint64(1)) * self.factor[k]
            at = np.searchsorted(self.trie, state)
            at[at == len(self.trie)] = 0
            stay = self.trie[at] == state
            live, state, at = live[stay], state[stay], at[stay]
            if not len(live):
                break
            entry = self.trie_id[at, (left[live] == k + 1).astype(np.int64)]
            found = entry >= 0
            best[live[found]] = entry[found]
        return best

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does each pair of tokens stay as it is side by side?"""
        out = np.ones(len(a), dtype=bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        never = np.int64(len(self.pair_key) + 1)
        x_until, y_until = (np.full(len(a), never, dtype=np.int64) for _ in range(2))
        while len(live):
            key = x * self.size + y
            at = np.searchsorted(self.pair_key, key)
            at[at == len(self.pair_key)] = 0
            across = np.where(self.pair_key[at] == key, self.rank[self.pair_made[at]], never)
            # A merge to the left of the border comes first at equal ranks, one to the right of it comes after.
            broken = (across < x_until) & (across <= y_until) & (across < never)
            out[live[broken]] = False
            more = ~broken & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y, x_until, y_until = live[more], x[more], y[more], x_until[more], y_until[more]
            undo = self.rank[x] > self.rank[y]
            x_until, y_until = np.where(undo, self.rank[x], x_until), np.where(undo, y_until, self.rank[y])
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def merged(self, word: bytes) -> list[int]:
        """The word's tokens by the definition: always the merge of least rank, leftmost of equals."""
        ids = [*self.middle_byte[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.end_byte[word[-1]])]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            made = self.pairs.get((ids[i], ids[j])) if j >= 0 else None
            if made is not None:
                heapq.heappush(waiting, (int(self.rank[made]), i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in ids if t >= 0]

    def _walk(self, best: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) along the longest entries, words and tokens in order."""
        words, tokens = [], []
        long = np.flatnonzero(lens > LONG_WORD)
        live = np.flatnonzero(lens <= LONG_WORD)
        at, end = starts[live], (starts + lens)[live]
        while len(live):
            token = best[at]
            words.append(live)
            tokens.append(token)
            at = at + self.length[token]
            more = at < end
            live, at, end = live[more], at[more], end[more]
        for w in long.tolist():
            part = best[starts[w] : starts[w] + lens[w]].tolist()
            size = self.length[part].tolist()
            place, found = 0, []
            while place < len(part):
                found.append(part[place])
                place += size[place]
            words.append(np.full(len(found), w))
            tokens.append(np.array(found, dtype=np.int64))
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _code(self, new: list[bytes]) -> list[np.ndarray]:
        lens = np.array([len(x) for x in new], dtype=np.int64)
        starts = np.cumsum(lens) - lens
        raw = np.frombuffer(b"".join(new), np.uint8)
        left = np.repeat(starts + lens, lens) - np.arange(len(raw))
        word, token = self._walk(self.longest_entries(raw, left), starts, lens)
        near = np.flatnonzero(word[1:] == word[:-1])
        key, back = np.unique(token[near] * self.size + token[near + 1], return_inverse=True)
        failed = np.zeros(len(new), dtype=bool)
        failed[word[near[~self.holds(key // self.size, key % self.size)[back]]]] = True
        # Hashes proposed the entries; their bytes have to be the words'.
        failed[np.repeat(np.arange(len(new)), lens)[ragged(self.entry_raw, self.entry_at[token], self.length[token]) != raw]] = True
        out = np.split(token.astype(self.cache.dtype), np.cumsum(np.bincount(word, minlength=len(new)))[:-1])
        for i in np.flatnonzero(failed).tolist():
            out[i] = np.array(self.merged(new[i]), dtype=self.cache.dtype)
        self.encoded += len(new)
        self.exact += int(failed.sum())
        return out

    def _library_words(self, text: str) -> list[bytes | int]:
        """Words of any text, by the library's normaliser and splitter; special tokens as their ids."""
        out: list[bytes | int] = []
        found = [*self.special_pattern.finditer(text)] if self.special_pattern else []
        at = 0
        for m in [*found, None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))
                out += [bytes(self.byte_of[c] for c in w) for w, _ in split if w]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        raw, offsets = flat(column)
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, self.cache.dtype), np.zeros(n, np.int64)
        low, starts, lens, unsure = words_of(raw, offsets)
        for s in self.special:
            unsure |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
        text = np.searchsorted(offsets, starts, side="right") - 1
        sure = ~unsure[text]
        starts, lens, text = starts[sure], lens[sure], text[sure]
        if len(starts):
            off, size = self.cache.lookup(low, starts, lens, hashes(low, starts, lens))
            ids = ragged(self.cache.pool, off, size)
        else:
            ids, size = np.zeros(0, self.cache.dtype), np.zeros(0, np.int64)
        counts = np.bincount(text, weights=size, minlength=n).astype(np.int64)
        slow = np.flatnonzero(unsure)
        if len(slow):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in slow.tolist():
                parts[i] = self._encode_words(self._library_words(column[i].as_py()))
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    def _encode_words(self, words: list[bytes | int]) -> np.ndarray:
        plain = [w for w in words if isinstance(w, bytes)]
        if not plain:
            return np.array(words, dtype=self.cache.dtype)
        lens = np.array([len(w) for w in plain], dtype=np.int64)
        starts = np.cumsum(lens) - lens
        raw = np.frombuffer(b"".join(plain), np.uint8)
        off, size = self.cache.lookup(raw, starts, lens, hashes(raw, starts, lens))
        coded = iter(np.split(ragged(self.cache.pool, off, size), np.cumsum(size)[:-1]))
        return np.concatenate([next(coded) if isinstance(w, bytes) else np.array([w], dtype=self.cache.dtype) for w in words])

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(decoded texts one after another, each with a space at its end; n + 1 offsets)."""
        ids = ids.astype(np.int64)
        size = self.surface_len[ids]
        return ragged(self.surface, self.surface_at[ids], size).tobytes(), np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file, while its tasks are of this operator."""
    held = kept("word pieces")
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


_SPACES = re.compile(rb"[ \n\r\t]")


def parts_of(text: pa.Scalar, most: int = CHUNK) -> Iterator[pa.Array]:
    """A long text in parts of about `most` bytes, each but the last ending at white space, where words end for certain."""
    data = text.as_buffer()
    at, size = 0, data.size
    while at < size:
        end = min(at + most, size)
        if end < size:
            view = memoryview(data)
            found = _SPACES.search(view, end)
            end = found.end() if found else size
        yield pa.array([bytes(memoryview(data)[at:end]).decode()], pa.string())
        at = end


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in batches:
            for doc_ids, texts in slices(batch, CHUNK):
                whole = len(texts) > 1 or (texts[0].as_buffer() or pa.py_buffer(b"")).size <= 2 * CHUNK
                counts, of_ids, of_text = [], [], []
                if whole:
                    ids, counts = held.encode_batch(texts)
                    coded = ids.astype("<u4").tobytes()
                    back, ends = held.decode_batch(ids, counts)
                    cut, ends = np.r_[0, np.cumsum(counts)].tolist(), ends.tolist()
                    of_ids = [hashlib.sha256(coded[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:])]
                    of_text = [hashlib.sha256(back[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:])]
                else:
                    total, hash_ids, hash_text = 0, hashlib.sha256(), hashlib.sha256()
                    for part in parts_of(texts[0]):
                        ids, n = held.encode_batch(part)
                        back, _ = held.decode_batch(ids, n)
                        if len(ids):
                            hash_text.update(b" " * (total > 0) + back[:-1])
                        total += len(ids)
                        hash_ids.update(ids.astype("<u4").tobytes())
                    counts, of_ids, of_text = [total], [hash_ids.hexdigest()], [hash_text.hexdigest()]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number and checksum of its ids, and the checksum of what they decode to."""
    return _texts(docs, id_col, text_col).mapInArrow(tidy(_digest(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in batches:
            for doc_ids, texts in slices(batch, CHUNK):
                ids, counts = held.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""
    return _texts(docs, id_col, text_col).mapInArrow(tidy(_encoded(path)), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            ids = np.asarray(lists.flatten().fill_null(-1))
            known = (ids >= 0) & (ids < held.size)
            back, ends = held.decode_batch(ids[known], np.bincount(row[known], minlength=len(lists)))
            ends = ends.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([back[a : max(a, b - 1)].decode() for a, b in zip(ends, ends[1:])], pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text). Ids beyond the vocabulary are left out, as by the library."""
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(_decoded(path)), "doc_id long, text string")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    return digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
