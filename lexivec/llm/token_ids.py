"""Operator 1, token-ID output: documents as token ids in files of Simple-8b words.

`write_ids` encodes texts, sorts them by id over range partitions, and writes one file per partition: a Parquet file whose
rows are segments of about SEGMENT ids. A segment holds its documents' ids and lengths, the packed words, and for every
block of 1,024 ids the word at which it starts. Readers go from document to document and decode the blocks of about SPAN
ids at a time from these places, so what they hold doesn't grow with a segment. `read_ids` gives whole documents back;
`digest` takes the checksum of a document longer than SPAN part by part.

Defined results: a null text counts as empty and gives the end id alone; equal doc_ids stay separate rows, ordered by text,
and may lie in several files where their texts begin differently; a null doc_id sorts first, like one of its own; equal
rows are separate documents with the same ids; a text is encoded whole, however long, and its segment holds all of it; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .bytetext import PieceCache, flat, hashes, kept, ragged, slices, tidy
from .shared import new_path, read_table, small_batches

END_ID = 2
SEGMENT = 1 << 19
#: Bytes of text that are encoded at once.
CHUNK = 4 << 20
#: Ids that a reader decodes at once.
SPAN = 1 << 16
#: Characters of a text by which documents of one id are dealt to files.
BEGINNING = 64

#: Classes of bytes for the tokenizer's pattern. Bytes of UNSURE make a text go to the tokenizer whole.
LETTER, DIGIT, SPACE, SIGN, UNSURE = range(5)


def _byte_classes() -> np.ndarray:
    out = np.full(256, UNSURE, dtype=np.uint8)
    for c in range(0x20, 0x7F):
        out[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN
    out[[9, 10, 13, 32]] = SPACE
    out[0xC3:0xCA] = LETTER  # lead bytes of U+00C0 to U+027F, all letters but for the two signs below
    return out


_CLASS = _byte_classes()
_SIGNS_C2 = np.array([c >= 0xA1 and unicodedata.category(chr(c))[0] in "PS" for c in range(256)])


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, text is unsure) of the pieces into which the byte-level pattern cuts the texts."""
    kind = _CLASS[raw]
    follows = (raw & 0xC0) == 0x80
    lead = np.flatnonzero(raw == 0xC2)
    if len(lead):
        good = lead[(lead + 1 < len(raw)) & _SIGNS_C2[raw[np.minimum(lead + 1, len(raw) - 1)]]]
        kind[good] = SIGN
    lead = np.flatnonzero(raw == 0xC3)
    if len(lead):
        kind[lead[np.isin(raw[np.minimum(lead + 1, len(raw) - 1)], [0x97, 0xB7])]] = SIGN
    tail = np.flatnonzero(follows)
    kind[tail] = kind[tail - 1]  # texts with characters of three bytes or more are unsure by their lead byte
    text_of_unsure = np.searchsorted(offsets, np.flatnonzero(kind == UNSURE), side="right") - 1
    unsure = np.zeros(len(offsets) - 1, dtype=bool)
    unsure[text_of_unsure] = True
    start = np.ones(len(raw), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start[offsets[:-1][offsets[:-1] < len(raw)]] = True
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    # A run of white space before a word gives up its last character: to the word if it is a space, else as a piece.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:-1]) + 1
    start[after - 1] = True
    start[after] = raw[after - 1] != 0x20
    # 's 't 'm 'd 're 've 'll are pieces where the apostrophe opens one.
    quote = np.flatnonzero((raw == 0x27) & start)
    if len(quote):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        inside = lambda n: quote + n - 1 < len(raw)
        short &= inside(2) & ~edge[np.minimum(quote + 1, len(raw))]
        long &= inside(3) & ~edge[np.minimum(quote + 1, len(raw))] & ~edge[np.minimum(quote + 2, len(raw))]
        for found, n in ((short, 2), (long, 3)):
            at = quote[found]
            start[at + 1] = False
            start[(at + n)[at + n < len(raw)]] = True
    starts = np.flatnonzero(start)
    return starts, np.diff(np.append(starts, len(raw))), unsure


SEGMENT_SCHEMA = "part long, seg long, seg_start long, n_ids long, doc_ids binary, doc_nulls binary, doc_lens binary, block_starts binary, words binary"


class Encoder:
    """Token ids of whole texts, each distinct piece encoded by the tokenizers library once while it is remembered.

    Texts with characters for which `pieces` isn't sure of the pattern, or with a special token's string, go to the
    library whole. Pieces are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u4") if self.tokenizer.get_vocab_size() > 1 << 16 else np.dtype("<u2")
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = PieceCache(self._code, self.kind)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _code(self, new: list[bytes]) -> list[np.ndarray]:
        """Pieces of a space and letters stand in one text, which the library cuts into them again."""
        out: list[np.ndarray] = [None] * len(new)  # type: ignore[list-item]
        worded = [i for i, x in enumerate(new) if len(x) > 1 and x[0] == 0x20 and _CLASS[x[1]] == LETTER]
        for k in range(0, len(worded), 2000):
            some = worded[k : k + 2000]
            got = self.tokenizer.encode(b"".join(new[i] for i in some).decode(), add_special_tokens=False)
            ids, word = np.asarray(got.ids, dtype=self.kind), np.asarray(got.word_ids, dtype=np.int64)
            if len(word) and word[-1] + 1 == len(some):
                cut = np.searchsorted(word, np.arange(len(some) + 1)).tolist()
                for i, a, b in zip(some, cut, cut[1:]):
                    out[i] = ids[a:b]
        for i, x in enumerate(new):
            if out[i] is None:
                out[i] = self.whole(x.decode("utf-8", "replace"))
        return out

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        raw, offsets = flat(column)
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        starts, lens, unsure = pieces(raw, offsets)
        for s in self.special:
            unsure |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
        text = np.searchsorted(offsets, starts, side="right") - 1
        sure = ~unsure[text]
        starts, lens, text = starts[sure], lens[sure], text[sure]
        off, size = self.cache.lookup(raw, starts, lens, hashes(raw, starts, lens))
        ids = ragged(self.cache.pool, off, size)
        counts = np.bincount(text, weights=size, minlength=n).astype(np.int64)
        slow = np.flatnonzero(unsure)
        if len(slow):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in slow.tolist():
                parts[i] = self.whole(column[i].as_py())
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary, while its tasks are of this operator."""
    held = kept("token ids")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _packed(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, seg_start = TaskContext.get().partitionId(), 0, 0
        code = encoder(vocabulary)
        end = np.array([end_id], dtype=code.kind)
        docs, nulls, lens, held, n_held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, starts = simple8b.encode(ids)
            row = [part, seg, seg_start, len(ids), np.array(docs, "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(), np.array(lens, "<i8").tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 4 + [pa.binary()] * 5)], names=[c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])

        for batch in batches:
            for ids_col, texts in slices(batch, CHUNK):
                ids, counts = code.encode_batch(texts)
                at = np.cumsum(counts) - counts
                for doc_id, a, n in zip(ids_col.to_pylist(), at.tolist(), counts.tolist()):
                    docs.append(doc_id or 0)
                    nulls.append(doc_id is None)
                    lens.append(n + 1)
                    held += [ids[a : a + n], end]
                    n_held += n + 1
                    if n_held >= SEGMENT:
                        yield out()
                        seg, seg_start = seg + 1, seg_start + n_held
                        docs, nulls, lens, held, n_held = [], [], [], [], 0
        if docs:
            yield out()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> None:
    """Encode `docs` and write them in ascending id order to files under `path`."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange(files, "doc_id", F.substring("text", 1, BEGINNING))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(tidy(_packed(vocabulary, end_id)), SEGMENT_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


class Segment:
    """A row of a file, read in spans of blocks."""

    def __init__(self, row: dict):
        self.words, self.offsets, self.n = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_starts"], "<u4"), row["n_ids"]
        self.lens = np.frombuffer(row["doc_lens"], "<i8")
        self.ends = np.cumsum(self.lens)
        self.begins = self.ends - self.lens
        self.doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_nulls"], np.uint8).astype(bool))

    def ids(self, first: int, last: int) -> np.ndarray:
        return simple8b.decode_span(self.words, self.offsets, self.n, first, last, np.dtype("<u4"))

    def groups(self) -> Iterator[tuple[int, int]]:
        """Neighbouring documents of at most SPAN ids, or one that is longer."""
        at = 0
        while at < len(self.lens):
            end = max(at + 1, int(np.searchsorted(self.ends, self.begins[at] + SPAN, side="right")))
            yield at, end
            at = end

    def checksums(self, at: int, end: int) -> list[int]:
        first, last = int(self.begins[at]), int(self.ends[end - 1])
        if last - first <= SPAN:
            ids = self.ids(first, last)
            return [zlib.crc32(ids[b - first : e - first]) for b, e in zip(self.begins[at:end].tolist(), self.ends[at:end].tolist())]
        crc = 0  # one document
        for k in range(first, last, SPAN):
            crc = zlib.crc32(self.ids(k, min(k + SPAN, last)), crc)
        return [crc]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment(row)
            crc = [x for at, end in segment.groups() for x in segment.checksums(at, end)]
            yield pa.RecordBatch.from_arrays(
                [segment.doc_ids, pa.array(np.full(len(crc), row["part"])), pa.array(row["seg_start"] + segment.begins), pa.array(segment.lens), pa.array(np.array(crc, dtype=np.int64))],
                names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
            )


def _texts_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment(row)
            for at, end in segment.groups():
                first = int(segment.begins[at])
                ids = segment.ids(first, int(segment.ends[end - 1]))
                bounds = np.r_[0, segment.ends[at:end] - first].astype(np.int32)
                yield pa.RecordBatch.from_arrays([segment.doc_ids.slice(at, end - at), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<long>), the end id included."""
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path).mapInArrow(tidy(_texts_of_ids), "doc_id long, ids array<long>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files under `path`: its place in the stream, its length and the checksum of its ids."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # One row for each file, so the running total below sees as many rows as there are files.
    size = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = size.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    docs = files.mapInArrow(tidy(_unpacked), "doc_id long, part long, at long, n_tokens long, ids_crc32 long")
    return docs.join(before, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_ids(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(spark, path)
