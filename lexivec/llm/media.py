"""Operator 5, telephony audio: mu-law, A-law and IMA ADPCM, expanded and resampled with numpy.

mu-law and A-law bytes expand through tables of 256 values, built from the rule of each law. ADPCM blocks (a 4-byte head
with the first sample and the step index, then two samples a byte, low half first) are decoded side by side: sample by
sample, all blocks of a batch at once. PCM is resampled by linear interpolation between neighbours.

`store` writes coded samples as WAV files in a binary column. `decode` reads such files back and gives the PCM at the
target rate, losslessly coded for storing: its even samples, then what its odd ones differ from the mean of their
neighbours (the prediction step of an integer wavelet by lifting, modulo 2**16). `restore` gives the samples back, and
`described` computes features from them. Files are handled some megabytes at a time, so memory is bounded by the longest
file (some 40 bytes for each of its bytes).

Defined results: a null payload counts as empty and is padded to one unit of 64 zero bytes; equal payloads give equal
files and features; equal rows stay separate; a payload of 4 GiB or more, which no WAV file holds, is an error; an empty
table gives no rows; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import slices, tidy
from .shared import Scratch, materialize, read_table, small_batches

UNIT = 64
#: How the tables of files and PCM are written: long pages and a high level, as neighbouring samples are much alike.
STORING = {"parquet.page.size": str(8 << 20), "parquet.compression.codec.zstd.level": "12"}
RATE, TARGET_RATE = 8000, 16000
#: Bytes of files that are decoded at once.
CHUNK = 2 << 20
# Format tags of WAV files.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")
# IMA ADPCM's change of the step index for each 3-bit magnitude. The steps are 89 values of its standard.
INDEX_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """Samples of all blocks, 2 * (block - 4) + 1 from each."""
    blocks = data.reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * (block - 4) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    for i in range(2 * (block - 4)):
        code = (body[i >> 1] >> (4 * (i & 1))) & 15
        step, size = STEPS[index], code & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_SHIFT[size], 0, len(STEPS) - 1)
        out[i + 1] = value
    return np.ascontiguousarray(out.T).ravel()


def resample(pcm: np.ndarray, rate: int = RATE, target: int = TARGET_RATE) -> np.ndarray:
    """Linear interpolation; the last sample is held."""
    if target == 2 * rate and len(pcm):
        out = np.empty(2 * len(pcm), dtype=np.int16)
        out[0::2] = pcm
        mid = pcm[:-1].astype(np.int32) + pcm[1:]
        out[1:-1:2] = mid >> 1
        out[-1] = pcm[-1]
        return out
    n = len(pcm) * target // rate
    return np.interp(np.arange(n) * (rate / target), np.arange(len(pcm)), pcm).astype(np.int16) if n else np.zeros(0, np.int16)


def wav(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file; the payload's length is a multiple of UNIT, so chunks are even."""
    if len(data) >= 1 << 32:
        raise ValueError("a WAV file holds less than 4 GiB")
    samples = len(data) if codec != "adpcm" else len(data) // UNIT * (2 * (UNIT - 4) + 1)
    if codec == "adpcm":
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * UNIT // (2 * (UNIT - 4) + 1), UNIT, 4, 2, 2 * (UNIT - 4) + 1)
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + len(data)) + b"WAVE" + chunks + data


def parse_wav(media: bytes) -> tuple[str, int, memoryview]:
    """(codec, rate, payload) of a file that `wav` wrote, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, RATE
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data":
            return next(c for c in CODECS if TAGS[c] == tag), rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(payload: bytes) -> bytes:
    return payload + b"\0" * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file for each payload; the payload's own checksum chooses the codec, so equal payloads get equal files."""
    for batch in batches:
        ids, n, media = batch.column(0), [], []
        for payload in batch.column(1):
            raw = payload.as_py() or b""
            n.append(len(raw))
            data = padded(raw)
            media.append(wav(CODECS[zlib.crc32(data) % len(CODECS)], data))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(payloads: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(doc_id, n_bytes, media): payloads as 8-bit samples (or ADPCM blocks) in WAV files, lossless to the byte."""
    return payloads.select(F.col(id_col).cast("long").alias("doc_id"), F.col(payload_col).cast("binary").alias("payload")).mapInArrow(tidy(_stored), "doc_id long, n_bytes long, media binary")


def pcm_features(pcm: np.ndarray) -> str:
    """Number of samples, peak, mean square, zero crossings and a checksum of the PCM."""
    below = pcm < 0
    crossings = int(np.count_nonzero(below[1:] != below[:-1]))
    peak = max(int(pcm.max(initial=0)), -int(pcm.min(initial=0)))
    # Squares of 16-bit samples are whole numbers that doubles add up exactly to 2**53, some 8 million samples at least.
    power = sum(int(np.einsum("i,i->", part, part)) for part in (pcm[i : i + (1 << 22)].astype(np.float64) for i in range(0, len(pcm), 1 << 22)))
    return f"{len(pcm)}:{peak}:{power // max(1, len(pcm))}:{crossings}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def decode_many(codecs: list[str], data: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of each file. The ADPCM blocks of all files are decoded side by side."""
    blocks = [i for i, c in enumerate(codecs) if c == "adpcm"]
    out = [np.zeros(0, np.int16) if c == "adpcm" else _TABLES[c][d] for c, d in zip(codecs, data)]
    if blocks:
        each = 2 * (UNIT - 4) + 1
        ends = np.cumsum([len(data[i]) // UNIT * each for i in blocks])
        for i, pcm in zip(blocks, np.split(decode_adpcm(np.concatenate([data[i] for i in blocks])), ends[:-1])):
            out[i] = pcm
    return out


def lifted(pcm: np.ndarray) -> bytes:
    """PCM as even samples and the odd ones' differences from the mean of their neighbours."""
    even, odd = pcm[0::2], pcm[1::2]
    return even.astype("<i2").tobytes() + (odd - _predicted(even, len(odd))).astype("<i2").tobytes()


def _predicted(even: np.ndarray, n: int) -> np.ndarray:
    after = np.append(even[1:], even[-1:])
    return ((even.astype(np.int32) + after) >> 1).astype(np.int16)[:n]


def restore(coded: bytes) -> np.ndarray:
    """The samples that `lifted` coded."""
    both = np.frombuffer(coded, "<i2").astype(np.int16)
    half = (len(both) + 1) // 2
    out = np.empty(len(both), np.int16)
    out[0::2] = both[:half]
    out[1::2] = both[half:] + _predicted(both[:half], len(both) - half)
    return out


FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


DECODED = f"{FACTS}, codec string, rate int, pcm binary"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, ns, medias in slices(batch, CHUNK, 2):
            files = medias.to_pylist()
            parsed = [parse_wav(m) for m in files]
            pcms = decode_many([c for c, _, _ in parsed], [np.frombuffer(d, np.uint8) for _, _, d in parsed])
            rows = []
            for doc_id, n, media, (codec, rate, data), samples in zip(ids.to_pylist(), ns.to_pylist(), files, parsed, pcms):
                facts = (doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest())
                rows.append((*facts, codec, TARGET_RATE, lifted(resample(samples, rate))))
            yield _rows(rows, DECODED)


def decode(files: DataFrame) -> DataFrame:
    """Files read back: what they hold, and the PCM at the target rate as `lifted` codes it."""
    return files.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_decoded), DECODED)


DESCRIBED = f"{FACTS}, feature string"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in slices(batch, 4 * CHUNK, batch.schema.get_field_index("pcm")):
            *facts, codec, _, pcm = (c.to_pylist() for c in cut)
            yield _rows([(*f, f"{c}:{pcm_features(restore(coded))}") for *f, c, coded in zip(*facts, codec, pcm)], DESCRIBED)


def described(decoded: DataFrame) -> DataFrame:
    """Stored PCM read back, with its features in its place."""
    return decoded.mapInArrow(tidy(_described), DESCRIBED)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are stored, read back, decoded and resampled; the PCM is stored, read back and described. The PCM stays in the
    shared folder, the files don't."""
    small_batches(spark)
    scratch = Scratch()
    files = scratch.keep(store(read_table(spark, sf_dir, "documents"), "doc_id", "text"), "media", "zstd", STORING)
    pcm = materialize(decode(files), "pcm", "zstd", STORING)
    scratch.clear()
    return described(pcm)
