"""Telephony audio: texts as payloads of mu-law, A-law and IMA ADPCM sound files.

A payload is the UTF-8 text, filled up with bytes 255 to a positive multiple of BLOCK. It
is stored unchanged as the sample data of a WAV file (8 kHz, one channel). Reading a file
back finds its data by the chunk headers and expands it: mu-law and A-law bytes by lookup
tables, ADPCM blocks sample by sample over all blocks of a batch at once. The sound is
resampled to 16 kHz PCM by a half-band cubic filter in whole numbers.

Which codec a payload gets in a mixed archive depends on the payload alone (its crc32), so
equal texts have equal files and features. Defined results: a null or empty text is one
block of 255s; repeated rows are stored once each; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_slices

BLOCK = 576
RATE = 8000
#: WAV format tags (fixed values).
FORMATS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
CODECS = tuple(FORMATS)
#: IMA ADPCM step sizes and index changes (fixed values).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
#: ADPCM blocks decoded together; bounds the decoder's memory.
BLOCKS_AT_ONCE = 4096


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, part = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(step == 0, part + 8, (part + 0x108) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For (step index, code): the change of the sample, and the next step index (times 16)."""
    code, step = np.arange(16), STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGES[code & 7], 0, len(STEPS) - 1) * 16
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), after.astype(np.int32).ravel()


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}
CHANGES, AFTER = adpcm_tables()


def write_wav(codec: str, payload: bytes) -> bytes:
    if codec == "adpcm":
        per_block = (BLOCK - 4) * 2 + 1
        extra = struct.pack("<HH", 2, per_block)
        rate, align, bits, samples = RATE * BLOCK // per_block, BLOCK, 4, len(payload) // BLOCK * per_block
    else:
        extra, rate, align, bits, samples = struct.pack("<H", 0), RATE, 1, 8, len(payload)
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, RATE, rate, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + struct.pack("<4sII4sI", b"fact", 4, samples, b"data", len(payload))
    return struct.pack("<4sI", b"RIFF", len(body) + len(payload)) + body + payload


def read_wav(media: bytes) -> tuple[str, int, int]:
    """Codec, and where the sample data start and end."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(k for k, v in FORMATS.items() if v == tag)
        elif kind == b"data":
            return codec, at + 8, at + 8 + size
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks (blocks x BLOCK bytes): a step for each sample, over all blocks."""
    out = np.empty((len(blocks), (BLOCK - 4) * 2 + 1), np.int16)
    for lo in range(0, len(blocks), BLOCKS_AT_ONCE):
        part = blocks[lo : lo + BLOCKS_AT_ONCE]
        codes = np.empty(((BLOCK - 4) * 2, len(part)), np.int32)
        codes[0::2], codes[1::2] = part[:, 4:].T & 15, part[:, 4:].T >> 4
        sample = np.ascontiguousarray(part[:, :2]).view("<i2")[:, 0].astype(np.int32)
        state = np.minimum(part[:, 2].astype(np.int32), len(STEPS) - 1) * 16
        steps = np.empty((len(codes) + 1, len(part)), np.int16)
        steps[0] = sample
        for i, code in enumerate(codes, 1):
            at = state + code
            sample = np.clip(sample + CHANGES[at], -32768, 32767)
            state = AFTER[at]
            steps[i] = sample
        out[lo : lo + len(part)] = steps.T
    return out


def upsample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, the points between are a cubic through four neighbours."""
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean square (whole) and sign changes of the sound."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{int(np.abs(wide).max())}:{int((wide * wide).sum()) // len(pcm)}:{crossings}"


def encode_texts(texts: list[str], codecs) -> list[bytes]:
    out = []
    for t in texts:
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % BLOCK or (BLOCK if not raw else 0))
        out.append(write_wav(codecs[zlib.crc32(payload) % len(codecs)], payload))
    return out


def decode_media(media: list[bytes]) -> list[tuple[int, str, np.ndarray]]:
    """Where the data start, the codec and the sound of each file; ADPCM blocks of all files together."""
    found = [read_wav(m) for m in media]
    data = [np.frombuffer(m, np.uint8)[lo:hi] for m, (_, lo, hi) in zip(media, found, strict=True)]
    coded = [d.reshape(-1, BLOCK) for d, (c, _, _) in zip(data, found, strict=True) if c == "adpcm"]
    sounds = iter(np.split(decode_adpcm(np.concatenate(coded)), np.cumsum([len(x) for x in coded])[:-1]) if coded else ())
    return [(lo, c, next(sounds).ravel() if c == "adpcm" else TABLES[c][d]) for d, (c, lo, _) in zip(data, found, strict=True)]


def store_audio(docs: DataFrame, *, codecs=CODECS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV file), data_start, codec, pcm (16 kHz, little-endian
    int16) and feature of every text. Needs no shuffle."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                media = encode_texts(texts, codecs)
                heard = decode_media(media)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("n_bytes"),
                        pa.array(media, pa.binary()),
                        pa.array([lo for lo, _, _ in heard], pa.int32()),
                        pa.array([c for _, c, _ in heard], pa.string()),
                        pa.array([upsample(x).astype("<i2").tobytes() for _, _, x in heard], pa.binary()),
                        pa.array([feature(c, x) for _, c, x in heard], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "media", "data_start", "codec", "pcm", "feature"],
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary, data_start int, codec string, pcm binary, feature string")


def digests(audio: DataFrame) -> DataFrame:
    payload = F.expr("substring(media, data_start + 1)")
    return audio.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.crc32("pcm").alias("pcm_crc32"),
    )
