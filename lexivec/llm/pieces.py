"""Operator 10, SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is a byte-pair one, where the best path is not a sum of scores: it is the one path on which every two
neighbouring pieces stay as they are when their joined text is encoded alone (merging is local, so this holds for a whole
text exactly if it holds for each pair, and the path of a text's start is the start of its path). So the lattice keeps, for
every place in the window, the one last piece that ends there, with its backpointer. Pieces have a greatest length; only
places from which the text up to now begins some piece can still be extended. After every character the backpointer paths
from all of these, and from the end, are followed to the boundary at which they meet; the pieces before it are committed
and leave the window. So the window holds the longest piece and the paths that are still open, whatever a text's length.

Whole columns go through the same search in units: between two characters that stand side by side in no piece, as a word's
end and the space after it, or two characters that the vocabulary doesn't hold, all paths meet. Each distinct unit is
searched once while it is remembered (told apart by 64-bit hashes, lengths and first bytes), and the ids of a text are
gathered from its units. A unit may be as long as a text; within it the search commits as it goes on.

Defined results: a null or empty text has no ids and decodes to an empty text; a text is encoded whole, however long; U+2581 reads as a space, as the model's own
encoder does; unknown characters fall back to bytes; equal rows stay separate; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import PieceCache, flat, hashes, kept, ragged, slices, tidy
from .shared import read_table, small_batches

SPACE = "▁"
# Types of pieces in the model file.
NORMAL, BYTE = 1, 6
CHUNK = 1 << 20
REMEMBERED_PAIRS = 1 << 18


class Model:
    """Pieces, scores and pair tests of a byte-pair SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only byte-pair models with byte fallback and no normalisation are read")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.longest = max(map(len, self.ids))
        #: Beginnings of pieces, without the pieces themselves unless longer ones go on from them.
        self.begun = {piece[:n] for piece in self.ids for n in range(1, len(piece))}
        self.commits, self.widest = 0, 0  # commits before a unit's end, and the most places that a window held
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            tails.setdefault(piece[-2:], set()).add(len(piece))
        #: Lengths, longest first, of the pieces that end in two characters.
        self.tails = {tail: tuple(sorted(n - {1}, reverse=True)) for tail, n in tails.items()}
        self.surface = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" for p in proto.pieces]
        # Which characters stand side by side in some piece. All others are cut apart.
        self.joined = np.zeros((128, 128), dtype=bool)
        wide = set()
        for piece in self.ids:
            for a, b in zip(plain := piece.replace(SPACE, " "), plain[1:]):
                if a < "\x80" and b < "\x80":
                    self.joined[ord(a), ord(b)] = True
                else:
                    wide.add(ord(a) << 21 | ord(b))
        self.wide = np.array(sorted(wide), dtype=np.int64)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache = PieceCache(self._code, np.dtype("<u2") if len(self.surface) <= 1 << 16 else np.dtype("<u4"))
        lens = np.array([len(s) for s in self.surface], dtype=np.int64)
        self.surface_at, self.surface_len = np.cumsum(lens) - lens, lens
        self.surface_raw = np.frombuffer(b"".join(self.surface), np.uint8)

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding of a short text, by its definition: always the best pair, the leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def holds(self, left: str, right: str) -> bool:
        """Do two pieces stay as they are side by side?"""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def ids_of(self, piece: str) -> list[int]:
        got = self.ids.get(piece)
        return [got] if got is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def _code(self, units: list[bytes]) -> list[np.ndarray]:
        out = []
        for unit in units:
            stream = Stream(self)
            ids = [i for p in stream.feed(unit.decode().replace(" ", SPACE)) for i in self.ids_of(p)]
            out.append(np.array(ids + [i for p in stream.finish() for i in self.ids_of(p)], dtype=self.cache.dtype))
        return out

    def _cuts(self, raw: np.ndarray) -> np.ndarray:
        """Which bytes of UTF-8 begin a character that stands in no piece after the one before it."""
        start = np.zeros(len(raw), dtype=bool)
        plain = raw < 0x80
        start[1:] = plain[1:] & plain[:-1]
        at = np.flatnonzero(start)
        start[at] = ~self.joined[raw[at - 1], raw[at]]
        if plain.all():
            return start
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        near = np.flatnonzero(~(plain[lead[1:]] & plain[lead[:-1]])) + 1
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])

        def codes(at: np.ndarray) -> np.ndarray:
            b = [padded[at + k].astype(np.int64) for k in range(4)]
            low = [x & 0x3F for x in b]
            two, three, four = (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2], (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
            return np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], four)

        pair = codes(lead[near - 1]) << 21 | codes(lead[near])
        found = np.searchsorted(self.wide, pair)
        found[found == len(self.wide)] = 0
        start[lead[near]] = self.wide[found] != pair if len(self.wide) else True
        return start

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        raw, offsets = flat(pc.replace_substring(column, SPACE, " "))
        n = len(offsets) - 1
        filled = np.diff(offsets) > 0
        # The model puts a space before each text.
        raw = np.insert(raw, offsets[:-1][filled], 0x20)
        offsets = offsets + np.r_[0, np.cumsum(filled)]
        if not len(raw):
            return np.zeros(0, self.cache.dtype), np.zeros(n, np.int64)
        start = self._cuts(raw)
        start[offsets[:-1][filled]] = True
        starts = np.flatnonzero(start)
        lens = np.diff(np.append(starts, len(raw)))
        off, size = self.cache.lookup(raw, starts, lens, hashes(raw, starts, lens))
        total = np.r_[0, np.cumsum(size)]
        counts = np.diff(total[np.searchsorted(starts, offsets)])
        return ragged(self.cache.pool, off, size), counts

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts' bytes; the space that the model put before each is taken away."""
        ids = ids.astype(np.int64)
        size = self.surface_len[ids]
        data = ragged(self.surface_raw, self.surface_at[ids], size).tobytes()
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(ends, ends[1:])]


class Stream:
    """Encodes a text that comes in parts, and gives its pieces as soon as they are certain."""

    def __init__(self, model: Model):
        self.model = model
        self.text = ""  # the window
        self.last: list[str] = [""]  # the last piece of the path to each place in the window
        self.open: list[int] = []  # places before the end from which a piece may still go beyond it, in order

    def feed(self, part: str) -> Iterator[str]:
        """Extend the lattice; gives the pieces that are committed on the way. It has to be read to its end."""
        model, ids, pairs, tails, begun = self.model, self.model.ids, self.model.pairs, self.model.tails, self.model.begun
        text, last, open_ = self.text, self.last, self.open
        for c in part:
            text += c
            end = len(text)
            chosen = c  # a character alone ends a path when nothing longer does
            if end > 1:
                for n in tails.get(text[end - 2 : end], ()):
                    if n <= end and (piece := text[end - n : end]) in ids:
                        left = last[end - n]
                        holds = pairs.get((left, piece))
                        if model.holds(left, piece) if holds is None else holds:
                            chosen = piece
                            break
            last.append(chosen)
            before = len(open_)
            if open_:
                open_ = [p for p in open_ if text[p:end] in begun]
            if c in begun:
                open_.append(end - 1)
            # Paths can come to meet only where one of them has ended.
            boundary = end if not open_ else self._meeting(last, open_, end) if len(open_) <= before else 0
            if boundary:
                if end > model.widest:
                    model.widest = end
                model.commits += 1
                yield from self._path(last, boundary)
                text, last = text[boundary:], last[boundary:]
                if open_:
                    open_ = [p - boundary for p in open_]
        self.text, self.last, self.open = text, last, open_

    @staticmethod
    def _meeting(last: list[str], open_: list[int], end: int) -> int:
        """The boundary at which the paths from all open places and the end meet."""
        meet = open_[0]
        for place in (*open_[1:], end):
            while place != meet:
                if place > meet:
                    place -= len(last[place])
                else:
                    meet -= len(last[meet])
            if not meet:
                break
        return meet

    @staticmethod
    def _path(last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def finish(self) -> list[str]:
        self.model.widest = max(self.model.widest, len(self.text))
        out = self._path(self.last, len(self.text))
        self.text, self.last, self.open = "", [""], []
        return out


def model(path: str) -> Model:
    """One for each worker and vocabulary, while its tasks are of this operator."""
    held = kept("pieces")
    if path not in held:
        held[path] = Model(path)
    return held[path]


def encode_parts(path: str, parts: Iterable[str]) -> Iterator[int]:
    """Ids of one text of any length that comes in parts, with memory for the window only."""
    m = model(path)
    stream, first = Stream(m), True
    for part in parts:
        if part:
            for piece in stream.feed(SPACE * first + part.replace(" ", SPACE)):
                yield from m.ids_of(piece)
            first = False
    for piece in stream.finish():
        yield from m.ids_of(piece)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for doc_ids, texts in slices(batch, CHUNK):
                ids, counts = m.encode_batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids, lists], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(_encoded(path)), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(1)
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            texts = [t.decode("utf-8", "replace") for t in m.decode_batch(np.asarray(lists.flatten()), counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text)."""
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(_decoded(path)), "doc_id long, text string")


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for doc_ids, texts in slices(batch, CHUNK):
                ids, counts = m.encode_batch(texts)
                back = m.decode_batch(ids, counts)
                raw, offsets = flat(texts)
                raw = raw.tobytes()
                wide = ids.astype("<u4").tobytes()
                cut = np.r_[0, np.cumsum(counts)].tolist()
                was = offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids,
                        pa.array(counts),
                        pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                        pa.array([zlib.crc32(t) for t in back], pa.int64()),
                        pa.array([t == raw[a:b] for t, a, b in zip(back, was, was[1:])], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "restored"],
                )

    return run


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number and checksum of its ids, and whether they decode to its text again."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(_digest(path)), "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, restored boolean")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    return digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
