"""Operator 6: telephony audio in media columns.

mu-law and A-law samples expand through 256-entry tables made from the formulas of G.711. IMA ADPCM blocks (a four-byte
header with predictor and step index, then four-bit codes) decode with numpy across all blocks of a slice: one pass over
the codes of a block, each step on every block at once. Decoded audio is resampled by a polyphase windowed sinc and stored
as 16-bit PCM.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm._shared import slices

#: WAVE format tags (fixed values of the RIFF registry).
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
NAMES = {v: k for k, v in TAGS.items()}
RATE = 8000
#: Code bytes of an ADPCM block; the header adds four.
BLOCK_CODES = 192
#: Bytes of media that a task decodes at once; samples take up to 16 times as much.
MEDIA_BYTES = 1 << 20
#: Samples that are resampled at once.
BLOCK_SAMPLES = 1 << 18

#: Step sizes and index changes of IMA ADPCM (fixed values of the format).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@lru_cache
def expansion(codec: str) -> np.ndarray:
    """16-bit sample of each 8-bit code."""
    code = np.arange(256)
    if codec == "mulaw":
        c = ~code & 0xFF
        size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
        return np.where(c & 128, -size, size).astype(np.int16)
    c = code ^ 0x55
    exponent, size = c >> 4 & 7, (c & 15) * 16 + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(c & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks, one row of bytes each: the predictor, then one sample a code, low four bits first."""
    value = blocks[:, 0:2].copy().view("<i2").ravel().astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1).T.astype(np.int32)
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, c in enumerate(codes):
        step = STEPS[index]
        size = (step >> 3) + (step & -(c & 1)) // 4 + (step & -(c >> 1 & 1)) // 2 + (step & -(c >> 2 & 1))
        value = np.clip(np.where(c & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + CHANGES[c & 7], 0, 88)
        out[k + 1] = value
    return out.T


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAVE file whose samples (or ADPCM codes, with zeroed block headers) are the payload's bytes."""
    if codec == "pcm":
        body = b"WAVE" + _chunk(b"fmt ", struct.pack("<HHIIHH", TAGS[codec], 1, rate, 2 * rate, 2, 16)) + _chunk(b"data", payload)
        return b"RIFF" + struct.pack("<I", len(body)) + body
    if codec == "adpcm":
        if len(payload) % BLOCK_CODES:
            raise ValueError(f"ADPCM needs a multiple of {BLOCK_CODES} bytes")
        rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_CODES)
        data = np.hstack([np.zeros((len(rows), 4), np.uint8), rows]).tobytes()
        per = BLOCK_CODES * 2 + 1
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * (BLOCK_CODES + 4) // per, BLOCK_CODES + 4, 4, 2, per)
        samples = len(rows) * per
    else:
        data, samples = payload, len(payload)
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    body = b"WAVE" + _chunk(b"fmt ", form) + _chunk(b"fact", struct.pack("<I", samples)) + _chunk(b"data", data)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, block size, data) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate, block = 12, "", 0, 1
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            codec = NAMES[tag]
        elif name == b"data":
            return codec, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def codes_of(media: bytes) -> bytes:
    """The 8-bit samples, or the codes of ADPCM blocks without their headers."""
    codec, _, block, data = read_wav(media)
    return _codes(codec, block, data)


def _codes(codec: str, block: int, data: bytes) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, 4:].tobytes() if codec == "adpcm" else data


def decode_many(media: list[bytes]):
    """(codec, rate, codes, 16-bit samples) of each file, in turn; the ADPCM blocks of all files are decoded together."""
    read = [read_wav(m) for m in media]
    blocks: dict[int, list[bytes]] = {}
    for codec, _, block, data in read:
        if codec == "adpcm":
            blocks.setdefault(block, []).append(data)
    decoded = {block: decode_adpcm(np.frombuffer(b"".join(d), np.uint8).reshape(-1, block)) for block, d in blocks.items()}
    at = dict.fromkeys(decoded, 0)
    for codec, rate, block, data in read:
        if codec == "adpcm":
            first, at[block] = at[block], at[block] + len(data) // block
            pcm = decoded[block][first : at[block]].ravel()
        else:
            pcm = np.frombuffer(data, "<i2") if codec == "pcm" else expansion(codec)[np.frombuffer(data, np.uint8)]
        yield codec, rate, _codes(codec, block, data), pcm


@lru_cache
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """One row of filter taps for each of the `up` places between two samples; rows sum to one."""
    cut = min(1.0, up / down)
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    taps = cut * np.sinc(cut * at) * np.cos(np.pi * at / (2 * half + 2)) ** 2
    return taps / taps.sum(axis=1, keepdims=True)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate, made block by block, so that memory besides the result is bounded."""
    if rate == to or not len(pcm):
        return pcm
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    taps = _phases(up, down).astype(np.float32)
    half = taps.shape[1] // 2
    step = BLOCK_SAMPLES // down * down
    out = []
    for first in range(0, len(pcm), step):
        last = min(first + step, len(pcm))
        around = pcm[max(0, first - half + 1) : last + half].astype(np.float32)
        x = np.pad(around, (max(0, half - 1 - first), max(0, last + half - len(pcm))), mode="edge")
        wide = np.empty((last - first, up), np.float32)
        for p in range(up):
            wide[:, p] = pcm[first:last] if p == 0 and up >= down else np.convolve(x, taps[p, ::-1], mode="valid")
        out.append(np.clip(np.rint(wide.reshape(-1)[::down]), -32768, 32767).astype(np.int16))
    return np.concatenate(out)


def _kind(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].simpleString().split(":", 1)[1]


def store_media(payloads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, payload, codec) to (id, media): a WAVE file for each row.

    A null payload or codec gives null media. Repeated rows, null ids and ties stay, other columns are not read, and an empty
    table gives an empty result; the same holds for the functions below.
    """

    def stored(batches):
        for s in slices(batches, "payload"):
            media = [write_wav(p, c) if p is not None and c is not None else None for p, c in zip(s.column("payload").to_pylist(), s.column("codec").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([s.column(id_col), pa.array(media, pa.binary())], [id_col, "media"])

    return payloads.select(id_col, "payload", "codec").mapInArrow(stored, f"{id_col} {_kind(payloads, id_col)}, media binary")


def _decoded(batch: pa.RecordBatch):
    """(row, media, codec, rate, codes, samples) of the rows of a batch that have media."""
    rows = batch.column("media").to_pylist()
    known = [i for i, m in enumerate(rows) if m is not None]
    for i, told in zip(known, decode_many([rows[i] for i in known]), strict=True):
        yield i, rows[i], *told


def decode_media(media: DataFrame, rate: int = 16000, id_col: str = "doc_id") -> DataFrame:
    """(id, media) to (id, codec, codes, pcm): the codes read back, and 16-bit PCM at `rate` as a WAVE file of its own.

    This is the stored form of resampled audio; where only its features are wanted, describe_media keeps it in the worker.
    Null media gives nulls. Equal media give equal values; rows are independent, so no shuffle and no skew.
    """

    def decoded(batches):
        for s in slices(batches, "media", MEDIA_BYTES):
            codec, codes, out = ([None] * s.num_rows for _ in range(3))
            for i, _, name, hz, raw, pcm in _decoded(s):
                codec[i], codes[i], out[i] = name, raw, write_wav(resample(pcm, hz, rate).astype("<i2").tobytes(), "pcm", rate)
            yield pa.RecordBatch.from_arrays([s.column(id_col), pa.array(codec, pa.string()), pa.array(codes, pa.binary()), pa.array(out, pa.binary())], [id_col, "codec", "codes", "pcm"])

    return media.select(id_col, "media").mapInArrow(decoded, f"{id_col} {_kind(media, id_col)}, codec string, codes binary, pcm binary")


def pcm_features(x: np.ndarray) -> str:
    """Samples, peak, root mean square and zero crossings, from integers, and the checksum of the bytes."""
    peak = power = crossings = 0
    for first in range(0, len(x), BLOCK_SAMPLES):
        part = x[max(0, first - 1) : first + BLOCK_SAMPLES].astype(np.int64)
        crossings += int(np.count_nonzero((part[1:] < 0) != (part[:-1] < 0)))
        own = part[1:] if first else part
        peak, power = max(peak, int(np.abs(own).max())), power + int((own * own).sum())
    return f"n={len(x)};peak={peak};rms={math.isqrt(power // len(x)) if len(x) else 0};zc={crossings};pcm_crc32={zlib.crc32(x.astype('<i2').tobytes())}"


def describe_media(media: DataFrame, rate: int = 16000, id_col: str = "doc_id") -> DataFrame:
    """Sizes and checksums of the codes and of the media, and the features of the PCM at `rate`, as read back from the bytes.

    Media is decoded, resampled and described in one function, slice by slice, so PCM, which is 4 to 8 times the size of its
    codes, never leaves the worker. Null media gives nulls.
    """
    names = [id_col, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def told(batches):
        for s in slices(batches, "media", MEDIA_BYTES):
            out = [[None] * s.num_rows for _ in names[1:]]
            for i, raw, codec, hz, codes, pcm in _decoded(s):
                feature = f"{codec};rate={rate};{pcm_features(resample(pcm, hz, rate))}"
                for column, x in zip(out, (len(codes), sha256(codes).hexdigest(), zlib.crc32(codes[-16:]), len(raw), sha256(raw).hexdigest(), feature), strict=True):
                    column[i] = x
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([s.column(id_col), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)

    return media.select(id_col, "media").mapInArrow(told, f"{id_col} {_kind(media, id_col)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
