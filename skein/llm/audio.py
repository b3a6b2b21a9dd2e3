"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE files, expanded with numpy and resampled."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, small_batches, written

RATE, TO_RATE = 8000, 16000
PAD, TAIL = 192, 16
#: WAVE format numbers, and the step and index rules of IMA ADPCM.
FORMATS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
IMA_STEPS = 89
IMA_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Bytes of nibbles in an ADPCM block; each block starts with 4 bytes of state.
BLOCK_DATA = 192
#: Half-band filter in 1/32768: the samples between two, from four on each side.
HALF_BAND = (-195, 1230, -4600, 19949, 19949, -4600, 1230, -195)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << ((code >> 4) & 7).astype(np.int32)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, part = ((code >> 4) & 7).astype(np.int32), (code & 15).astype(np.int32) << 4
    size = np.where(exponent > 0, part + 264 << np.maximum(exponent - 1, 0), part + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


#: The 89 step sizes of IMA ADPCM.
_IMA = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
LAWS = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}
STEP = np.array(_IMA, dtype=np.int32)


def padded(data: bytes) -> bytes:
    """data and as many spaces as make its length a positive multiple of 192."""
    return data + b" " * (max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def store(payload: bytes, codec: str) -> bytes:
    """A WAVE file whose samples are the payload: a byte is a mu-law or A-law sample, or two ADPCM nibbles in blocks that start from silence."""
    if codec == "ima_adpcm":
        block = 4 + BLOCK_DATA
        samples = BLOCK_DATA * 2 + 1
        body = b"".join(struct.pack("<hBB", 0, 0, 0) + payload[i : i + BLOCK_DATA] for i in range(0, len(payload), BLOCK_DATA))
        extra, rate, bits = struct.pack("<HH", 2, samples), RATE * block // samples, 4
    else:
        body, block, extra, rate, bits = payload, 1, struct.pack("<H", 0), RATE, 8
    head = struct.pack("<HHIIHH", FORMATS[codec], 1, RATE, rate, block, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def load(media: bytes) -> tuple[str, bytes]:
    """(codec, payload) of a WAVE file that store() made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, parts = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        parts[name] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    number, _, _, _, block, _ = struct.unpack("<HHIIHH", parts[b"fmt "][:16])
    codec = {v: k for k, v in FORMATS.items()}[number]
    body = parts[b"data"]
    if codec == "ima_adpcm":
        body = b"".join(body[i + 4 : i + block] for i in range(0, len(body), block))
    return codec, body


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """(blocks, 385) samples of (blocks, 192) bytes: each step decodes a nibble of every block; low nibbles come first."""
    blocks, width = data.shape
    out = np.zeros((blocks, width * 2 + 1), dtype=np.int16)
    value, index = np.zeros(blocks, dtype=np.int32), np.zeros(blocks, dtype=np.int32)
    move = np.array(IMA_INDEX, dtype=np.int32)
    for at in range(width * 2):
        nibble = (data[:, at // 2] >> (4 * (at & 1)) & 15).astype(np.int32)
        step = STEP[index]
        change = (step >> 3) + (step & -(nibble & 1)) // 4 + (step & -(nibble >> 1 & 1)) // 2 + (step & -(nibble >> 2 & 1))
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + move[nibble & 7], 0, IMA_STEPS - 1)
        out[:, at + 1] = value
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between them a half-band filter's, in whole numbers; ends are held."""
    wide = np.concatenate([np.full(3, pcm[0]), pcm, np.full(4, pcm[-1])]).astype(np.int32)
    between = sum(tap * wide[k : k + len(pcm)] for k, tap in enumerate(HALF_BAND)) >> 15
    out = np.empty(len(pcm) * 2, dtype=np.int16)
    out[::2], out[1::2] = pcm, np.clip(between, -32768, 32767)
    return out


def expand(media: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """(codec, payload, resampled PCM) of WAVE files: laws by lookup, ADPCM for all blocks of all files at once."""
    loaded = [load(m) for m in media]
    blocks = [np.frombuffer(p, np.uint8).reshape(-1, BLOCK_DATA) for c, p in loaded if c == "ima_adpcm"]
    decoded = iter(np.split(decode_adpcm(np.concatenate(blocks)), np.cumsum([len(b) for b in blocks])[:-1])) if blocks else iter(())
    return [(c, p, resample(next(decoded).reshape(-1) if c == "ima_adpcm" else LAWS[c][np.frombuffer(p, np.uint8)])) for c, p in loaded]


def features(codec: str, pcm: np.ndarray) -> str:
    """Codec, rate, samples, peak, root mean square, zero crossings and checksum of the resampled PCM."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};rate={TO_RATE};samples={len(pcm)};peak={int(np.abs(wide).max())};rms={int(np.sqrt((wide * wide).mean()))};crossings={crossings};pcm_crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"


def codec_of(payload: bytes) -> str:
    """The codec a payload is stored with: by its checksum, so equal texts have equal files."""
    return tuple(FORMATS)[zlib.crc32(payload) % 3]


#: Bytes of media that are held and decoded at once.
HOLD_BYTES = 1 << 21
#: Parts of the media table whose PCM is in the shared folder at a time, unless it is kept.
PARTS = 16
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_DIGESTS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
_PCM = pa.schema([*_DIGESTS, ("codec", pa.string()), ("rate", pa.int32()), ("pcm", pa.binary())])
_NAMED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def stored_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of documents: the whole text in UTF-8, padded with spaces, as a WAVE file.

    Null texts are empty and give one padded unit. Equal texts give equal files. Rows
    that repeat give a row each, a null doc_id stays null, no rows give no rows; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)

    def write(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            media = [store(p, codec_of(p)) for p in map(padded, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=_MEDIA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def pcm_column(media: DataFrame) -> DataFrame:
    """Media (doc_id, n_bytes, media) as digests of what the stored bytes hold, codec, rate and the resampled 16-bit samples `pcm`."""
    small_batches(media.sparkSession)

    def rows(ids, sizes, files):
        out: dict[str, list] = {n: [] for n in _PCM.names}
        for doc_id, n, m, (codec, payload, pcm) in zip(ids, sizes, files, expand(files), strict=True):
            for name, value in zip(out, (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(m), hashlib.sha256(m).hexdigest(), codec, TO_RATE, pcm.astype("<i2").tobytes()), strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=_PCM)

    def read(batches):
        for b in batches:
            ids, sizes, files = (c.to_pylist() for c in b.columns)
            start = held = 0
            for at, m in enumerate(files):
                held += len(m)
                if held >= HOLD_BYTES:
                    yield rows(ids[start : at + 1], sizes[start : at + 1], files[start : at + 1])
                    start, held = at + 1, 0
            if start < len(files):
                yield rows(ids[start:], sizes[start:], files[start:])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, f"{_NAMED}, codec string, rate int, pcm binary")


def pcm_features(pcm: DataFrame) -> DataFrame:
    """The digests of pcm_column() and a feature of its samples."""
    small_batches(pcm.sparkSession)

    def read(batches):
        for b in batches:
            found = [features(codec, np.frombuffer(samples, dtype="<i2")) for codec, samples in zip(b.column("codec").to_pylist(), b.column("pcm").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(_DIGESTS)], pa.array(found, pa.string())], names=[*(n for n, _ in _DIGESTS), "feature"])

    return pcm.mapInArrow(read, f"{_NAMED}, feature string")


def telephony_columns(docs: DataFrame, keep: str | None = None, parts: int = PARTS) -> DataFrame:
    """Digests and features of documents' media, all of what is read back from stored bytes.

    The media are written as a table and read back; their resampled PCM is written and read
    back likewise, a part of the table at a time, for it takes four to eight bytes for each
    byte of text: a part's is deleted once its features are written, unless `keep` names
    the folder that it is to stay in. See stored_media().
    """
    spark = docs.sparkSession
    media = written(stored_media(docs).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")), by="part", compression="zstd")
    out = None
    for part in range(parts):
        one = pcm_column(media.filter(F.col("part") == part))
        if keep:
            one.write.mode("append").parquet(keep)
            found = written(pcm_features(spark.read.parquet(keep).select(*_PCM.names))) if part == parts - 1 else None
        else:
            pcm = written(one, compression="zstd")
            found = written(pcm_features(pcm))
            drop_written(pcm)
        if found is not None:
            out = found if out is None else out.union(found)
    drop_written(media)
    return out
