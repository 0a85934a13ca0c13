"""Telephony audio columns: G.711 lookup tables, IMA ADPCM blocks, resampling and WAV storage.

Bytes are stored as 8-bit mu-law samples in a RIFF/WAVE container, which is lossless: each payload
byte is one sample code. Decoding expands codes through 256-entry tables, decodes 4-bit ADPCM with
numpy across all blocks at once (one step per sample position, every block in parallel) and doubles
the rate by linear interpolation. The resampled 16-bit PCM is stored as a column of its own beside
the payload's, and read back from there.

ADPCM files are read by their block size: each block begins with a predictor, a step index and a
reserved byte, the predictor is the block's first sample, and only ``fact`` samples are kept. A last
block that is cut short gives the samples it has.

Defined results: null text is an empty payload, padded like any other; texts of any length are stored
whole; equal payloads give equal media and features; an empty table gives an empty result; other
columns are carried along unread. New columns come last; where the table has one of that name, the
new one's gets underscores at its end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from strandex.runtime import fresh

RATE = 8000
UNIT = 192
MULAW, ALAW, IMA_ADPCM, PCM = 7, 6, 17, 1
ADPCM_BLOCK = 64


def mulaw_table() -> np.ndarray:
    """Linear value of each of the 256 mu-law codes, by the segment rule of G.711."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each of the 256 A-law codes, by the segment rule of G.711."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, step = (code >> 4) & 7, (code & 0x0F) << 4
    magnitude = np.where(segment == 0, step + 8, (step + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 quantiser steps: 7 growing by a tenth each time, as integers of a fixed table.

    # fixed values: the published IMA step table
    """
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int32,
    )


INDEX_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
_MU, _A, _STEPS = mulaw_table(), alaw_table(), ima_steps()


def expand(codes: np.ndarray, law: int = MULAW) -> np.ndarray:
    """8-bit G.711 codes to 16-bit samples."""
    return (_MU if law == MULAW else _A)[codes]


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, nibble): the change of the predictor and the next step index."""
    step, nibble = _STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    index = np.clip(np.arange(len(_STEPS))[:, None] + INDEX_SHIFT[None, :], 0, len(_STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


_CHANGE, _NEXT = _transitions()


def decode_adpcm(blocks: np.ndarray, predictor: np.ndarray | None = None, index: np.ndarray | None = None) -> np.ndarray:
    """4-bit IMA codes, one block a row, to 16-bit samples; low nibble first.

    The state (predictor, step index) is sequential within a block, so the loop runs over sample
    positions and each step handles all blocks.
    """
    n, width = blocks.shape
    value = np.zeros(n, np.int32) if predictor is None else predictor.astype(np.int32)
    at = np.zeros(n, np.int32) if index is None else index.astype(np.int32) * 16
    by_position = np.ascontiguousarray(blocks.T)
    out = np.empty((2 * width, n), np.int16)
    for j in range(width):
        for half, nibble in ((0, by_position[j] & 15), (1, by_position[j] >> 4)):
            state = at + nibble
            value = np.minimum(np.maximum(value + _CHANGE[state], -32768), 32767)
            at = _NEXT[state]
            out[2 * j + half] = value
    return np.ascontiguousarray(out.T)


def encode_adpcm(samples: np.ndarray) -> np.ndarray:
    """The inverse for tests and writers: rows of 16-bit samples (even length) to rows of codes."""
    n, width = samples.shape
    value, at = np.zeros(n, np.int32), np.zeros(n, np.int32)
    codes = np.empty((width, n), np.uint8)
    for j in range(width):
        table = np.clip(value[:, None] + _CHANGE[at[:, None] + np.arange(16)[None, :]], -32768, 32767)
        codes[j] = np.abs(table - samples[:, j, None].astype(np.int32)).argmin(axis=1)
        state = at + codes[j]
        value, at = np.minimum(np.maximum(value + _CHANGE[state], -32768), 32767), _NEXT[state]
    return (codes[0::2] | (codes[1::2] << 4)).T.copy()


def upsample2(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; the last sample is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def wav(data: bytes, kind: int = MULAW, rate: int = RATE, bits: int = 8, block: int | None = None, samples: int | None = None) -> bytes:
    """A mono RIFF/WAVE file around ``data`` (padded to an even chunk, as the format asks).

    ``block`` is the size of a block, a sample's width unless given; ``samples`` how many ``data`` holds.
    """
    width = max(1, bits // 8)
    block = block or width
    extra = struct.pack("<HH", 2, adpcm_samples(block)) if kind == IMA_ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block // (adpcm_samples(block) if kind == IMA_ADPCM else 1), block, bits) + extra
    fact = struct.pack("<I", len(data) // width if samples is None else samples)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<I", 4) + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Wave:
    kind: int
    channels: int
    rate: int
    block: int
    bits: int
    samples: int | None  # of the fact chunk
    data: bytes


def read_wav(media: bytes) -> Wave:
    """Format and data of a WAVE file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt, samples = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"fact" and size >= 4:
            samples = struct.unpack_from("<I", media, at + 8)[0]
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before format")
            kind, channels, rate, _, block, bits = fmt
            return Wave(kind, channels, rate, block, bits, samples, media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


HEADER = 4


def adpcm_samples(block: int) -> int:
    """Samples of one block: that of its header and two for each byte after it."""
    return 1 + 2 * (block - HEADER)


def decode_adpcm_file(data: bytes, block: int, samples: int | None = None) -> np.ndarray:
    """16-bit samples of mono IMA blocks with their headers, all blocks at once."""
    if block <= HEADER:
        raise ValueError(f"a block of {block} bytes holds no samples")
    whole, left = divmod(len(data), block)
    parts = [np.frombuffer(data, np.uint8, whole * block).reshape(whole, block)]
    if left > HEADER:
        parts.append(np.frombuffer(data, np.uint8, left, whole * block).reshape(1, left))
    out = []
    for blocks in parts:
        predictor = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0]
        index = np.minimum(blocks[:, 2], len(_STEPS) - 1)
        codes = decode_adpcm(np.ascontiguousarray(blocks[:, HEADER:]), predictor, index)
        out.append(np.concatenate([predictor[:, None], codes], axis=1).astype(np.int16).ravel())
    return np.concatenate(out)[:samples]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes padded with spaces to a positive multiple of 192)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * ((UNIT - len(raw) % UNIT) % UNIT if raw else UNIT)


def pcm_of(media: bytes) -> tuple[np.ndarray, int]:
    """Stored media to 16-bit samples and their rate."""
    w = read_wav(media)
    if w.channels != 1:
        raise ValueError(f"{w.channels} channels are not supported")
    if w.kind in (MULAW, ALAW) and w.bits == 8:
        return expand(np.frombuffer(w.data, np.uint8), w.kind), w.rate
    if w.kind == IMA_ADPCM and w.bits == 4:
        return decode_adpcm_file(w.data, w.block, w.samples), w.rate
    if w.kind == PCM and w.bits == 16:
        return np.frombuffer(w.data, "<i2", len(w.data) // 2), w.rate
    raise ValueError(f"format {w.kind} with {w.bits} bits is not supported")


def resampled(media: bytes) -> bytes:
    """The stored form of the same audio at twice the rate, as 16-bit PCM."""
    pcm, rate = pcm_of(media)
    return wav(upsample2(pcm).astype("<i2").tobytes(), PCM, 2 * rate, 16)


def _level(pcm: np.ndarray) -> str:
    wide = pcm.astype(np.int64)
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{int(np.sqrt(float((wide * wide).sum()) / len(pcm)))}/{turns}"


def features(data_list: list[bytes]) -> list[str]:
    """Per payload: level and zero crossings as mu-law, A-law and ADPCM codes.

    ADPCM blocks of all payloads are decoded together; here blocks have no header and start from a
    silent state, since any bytes may be read as codes.
    """
    blocks = [np.frombuffer(d, np.uint8) for d in data_list]
    counts = [len(b) // ADPCM_BLOCK for b in blocks]
    out, first = [], 0
    joined = np.concatenate(blocks).reshape(-1, ADPCM_BLOCK)
    decoded = decode_adpcm(joined)
    for codes, n in zip(blocks, counts, strict=True):
        out.append(f"mu={_level(expand(codes, MULAW))};a={_level(expand(codes, ALAW))};ima={_level(decoded[first : first + n].ravel())}")
        first += n
    return out


def pcm_feature(pcm: bytes) -> str:
    """Rate and a CRC of the samples of stored PCM."""
    w = read_wav(pcm)
    return f"pcm{w.rate}={zlib.crc32(w.data):08x}"


CHUNK = 1 << 20


def _spans(sizes: list[int]) -> Iterator[slice]:
    """Runs of items with about CHUNK bytes each."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > CHUNK:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _sizes(column: pa.Array) -> list[int]:
    """Bytes of each text or binary; null has none."""
    return [n or 0 for n in pc.binary_length(column).to_pylist()]


def to_media(docs: DataFrame, text: str = "text", n_bytes: str = "n_bytes", media: str = "media", pcm: str = "pcm") -> DataFrame:
    """Adds three columns at the end: the unpadded size, the stored form of every text (a mu-law WAVE file), and its audio as PCM at twice the rate.

    Batches leave in runs of about a MB of text, so that a task holds little at a time.
    """
    names = [fresh(docs, n) for n in (n_bytes, media, pcm)]
    out = StructType([*docs.schema, StructField(names[0], LongType()), StructField(names[1], BinaryType()), StructField(names[2], BinaryType())])
    at = docs.columns.index(text)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in _spans(_sizes(batch.column(at))):
                some = batch.slice(span.start, span.stop - span.start)
                made = [payload_of(t) for t in some.column(at).to_pylist()]
                files = [wav(p) for _, p in made]
                new = [pa.array([n for n, _ in made], pa.int64()), pa.array(files, pa.binary()), pa.array([resampled(m) for m in files], pa.binary())]
                yield pa.RecordBatch.from_arrays([*some.columns, *new], names=[*some.schema.names, *names])

    return docs.mapInArrow(store, out)


READ = (("payload_bytes", LongType(), pa.int64()), ("payload_sha256", StringType(), pa.string()), ("tail_crc32", LongType(), pa.int64()), ("media_bytes", LongType(), pa.int64()), ("media_sha256", StringType(), pa.string()), ("feature", StringType(), pa.string()), ("pcm_bytes", LongType(), pa.int64()))


def read_media(stored: DataFrame, media: str | None = None, pcm: str | None = None, into: str = "read", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct at the end of what the stored bytes hold: payload size and digests, and the features of payload and PCM.

    Unless named, media and PCM are the last two columns, as :func:`to_media` leaves them. Other
    columns stay, or those of ``keep``; leaving out the media themselves saves their way back.
    """
    media_at, pcm_at = (stored.columns.index(c) if c else len(stored.columns) - back for c, back in ((media, 2), (pcm, 1)))
    kept = [i for i, c in enumerate(stored.columns) if keep is None or c in keep]
    name, names = fresh(stored, into), [stored.columns[i] for i in kept]
    out = StructType([*[stored.schema[i] for i in kept], StructField(name, StructType([StructField(n, t) for n, t, _ in READ]))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in _spans(_sizes(batch.column(media_at))):
                some = batch.slice(span.start, span.stop - span.start)
                files, rows = some.column(media_at).to_pylist(), []
                payloads = [read_wav(m).data for m in files]
                for m, p, f, w in zip(files, payloads, features(payloads), some.column(pcm_at), strict=True):
                    w = w.as_py()
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{f};{pcm_feature(w)}", len(w)))
                columns = [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), READ, strict=True)]
                made = pa.StructArray.from_arrays(columns, names=[n for n, _, _ in READ])
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in kept], made], names=[*names, name])

    return stored.mapInArrow(read, out)


def op3_telephony_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_media(to_media(docs), keep=["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "read.*")
