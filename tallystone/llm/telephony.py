"""Operator 10: telephony audio columns.

Three 8 kHz mono codecs in RIFF/WAVE files: mu-law and A-law, expanded by lookup tables of 256 entries, and IMA ADPCM, whose blocks carry
their own starting state, so numpy decodes one sample of every block at a time. PCM is stored resampled to another rate by linear
interpolation in whole numbers.

A payload of bytes is stored losslessly as the codec's own units (8-bit codes, or pairs of 4-bit codes behind block headers). The codec
follows from the payload's CRC-32, so equal texts have equal media.

Rows: one for each input row, repeated rows and null ids included. A null or empty text has a payload of 64 zero bytes. Equal texts have equal values. Media that are null
or broken read as null columns and a reason. Other columns are not read; an empty table gives an empty result. Whole texts are stored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import documents, map_texts, slices, with_id

RATE, STORED_RATE = 8000, 16000
#: Format tags of RIFF/WAVE (fixed values).
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
BLOCK, HEADER = 256, 4
#: How an ADPCM code moves the index into the step table (fixed values).
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, "i4")
#: ADPCM step sizes (fixed values).
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
        190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
        18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    "i4",
)


@lru_cache(2)
def expansion(codec: str) -> np.ndarray:
    """The 256 linear values of mu-law or A-law codes, from the companding rule of G.711."""
    code = np.arange(256, dtype="i4")
    if codec == "mulaw":
        code = ~code & 0xFF
        value = ((((code & 0xF) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
        return np.where(code & 0x80, -value, value).astype("i2")
    code = code ^ 0x55
    exponent = (code >> 4) & 7
    value = (((code & 0xF) << 4) + 8 + np.where(exponent > 0, 0x100, 0)) << np.maximum(exponent - 1, 0)
    return np.where(code & 0x80, value, -value).astype("i2")


def codec_of(payload: bytes) -> str:
    return list(TAGS)[zlib.crc32(payload) % len(TAGS)]


def pack(payload: bytes, codec: str) -> bytes:
    """A WAVE file that holds the payload's bytes as codes."""
    if codec == "adpcm":
        room = BLOCK - HEADER
        data = b"".join(bytes(HEADER) + payload[i : i + room] for i in range(0, len(payload), room))
        samples = 2 * len(payload) + -(-len(payload) // room)
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * BLOCK // (2 * room + 1), BLOCK, 4, 2, 2 * room + 1)
    else:
        data, samples = payload, len(payload)
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
    chunks = [(b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)]
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + bytes(len(v) % 2) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[str, int, bytes]:
    """codec, sample rate and the data chunk; ValueError on anything else."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, chunks = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk is cut short")
        chunks[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if len(chunks.get(b"fmt ", b"")) < 16 or b"data" not in chunks:
        raise ValueError("no format or data chunk")
    tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
    codec = {v: k for k, v in TAGS.items()}.get(tag)
    if codec is None or channels != 1 or rate < 1 or codec == "adpcm" and align != BLOCK:
        raise ValueError("not a mono telephony codec")
    return codec, rate, chunks[b"data"]


def payload_of(codec: str, data: bytes) -> bytes:
    """The codes alone."""
    return data if codec != "adpcm" else b"".join(data[i + HEADER : i + BLOCK] for i in range(0, len(data), BLOCK))


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks (a row each): every step decodes one code of all blocks."""
    codes = blocks[:, HEADER:]
    codes = np.stack([codes & 15, codes >> 4], 2).reshape(len(blocks), -1).T.astype("i4")
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype("i4")
    index = np.clip(blocks[:, 2].astype("i4"), 0, len(STEPS) - 1)
    out = np.empty((len(codes) + 1, len(blocks)), "i2")
    out[0] = value
    for t, code in enumerate(codes, 1):
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, len(STEPS) - 1)
        out[t] = value
    return out.T


def decode_many(items: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """16-bit samples of each (codec, data); the ADPCM blocks of all of them are decoded together."""
    cut = {i: [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)] for i, (codec, data) in enumerate(items) if codec == "adpcm"}
    flat = [b.ljust(BLOCK, b"\0") for blocks in cut.values() for b in blocks]
    decoded = decode_blocks(np.frombuffer(b"".join(flat), "u1").reshape(-1, BLOCK)) if flat else np.zeros((0, 0), "i2")
    out, at = [], 0
    for i, (codec, data) in enumerate(items):
        if codec != "adpcm":
            out.append(expansion(codec)[np.frombuffer(data, "u1")])
            continue
        n = len(cut[i])
        last = max(0, len(cut[i][-1]) - HEADER) * 2 + 1 if n else 0
        out.append(decoded[at : at + n].reshape(-1)[: (n - 1) * decoded.shape[1] + last] if n else np.zeros(0, "i2"))
        at += n
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        x = pcm.astype("i4")
        out = np.empty(2 * len(x), "i2")
        out[::2] = pcm
        out[1:-1:2] = (x[:-1] + x[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    place = np.arange(len(pcm) * to // rate, dtype="i8") * rate
    left, part = place // to, place % to
    x = pcm.astype("i8")
    return ((x[left] * (to - part) + x[np.minimum(left + 1, len(x) - 1)] * part) // to).astype("i2")


def features(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, root of the mean square, zero crossings and clipped samples, all whole numbers."""
    x = pcm.astype("i8")
    energy = int(x @ x)
    signs = pcm >= 0
    return (
        f"codec={codec};samples={len(pcm)};peak={int(np.abs(x).max(initial=0))};rms={int((energy // max(1, len(pcm))) ** 0.5)};"
        f"crossings={int((signs[1:] != signs[:-1]).sum())};clipped={int((np.abs(x) >= 32767).sum())}"
    )


#: What can be returned for each text.
OUTPUTS = {
    "n_bytes": ("long", pa.int64()),
    "payload": ("binary", pa.binary()),
    "payload_bytes": ("long", pa.int64()),
    "payload_sha256": ("string", pa.string()),
    "tail_crc32": ("long", pa.int64()),
    "media": ("binary", pa.binary()),
    "media_bytes": ("long", pa.int64()),
    "media_sha256": ("string", pa.string()),
    "pcm": ("binary", pa.binary()),
    "pcm_bytes": ("long", pa.int64()),
    "pcm_sha256": ("string", pa.string()),
    "feature": ("string", pa.string()),
}


def store_texts(
    df: DataFrame, outputs: tuple[str, ...] = ("media", "pcm", "feature"), codec: str | None = None, stored_rate: int = STORED_RATE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and the named OUTPUTS: each text's bytes, padded with zeros to a positive multiple of 64, stored as telephony media, read back
    and decoded. codec: one for all, or None to let the payload decide. pcm: 16-bit little-endian samples at stored_rate."""

    wanted = {"pcm", "pcm_bytes", "pcm_sha256", "feature"}

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            raw = [t.encode() for t in texts]
            padded = [b.ljust(max(64, -(-len(b) // 64) * 64), b"\0") for b in raw]
            media = [pack(p, codec or codec_of(p)) for p in padded]
            read = [parse(m) for m in media]
            columns: dict[str, list] = {x: [] for x in outputs}
            sounds = decode_many([(c, d) for c, _, d in read])
            for bytes_, stored, (kind, rate, data), sound in zip(raw, media, read, sounds, strict=True):
                payload = payload_of(kind, data)
                pcm = resample(sound, rate, stored_rate) if wanted & {*outputs} else sound
                stored_pcm = pcm.astype("<i2").tobytes() if wanted - {"feature"} & {*outputs} else b""
                for x, column in columns.items():
                    if x == "n_bytes":
                        column.append(len(bytes_))
                    elif x == "payload":
                        column.append(payload)
                    elif x == "payload_bytes":
                        column.append(len(payload))
                    elif x == "payload_sha256":
                        column.append(hashlib.sha256(payload).hexdigest())
                    elif x == "tail_crc32":
                        column.append(zlib.crc32(payload[-64:]))
                    elif x == "media":
                        column.append(stored)
                    elif x == "media_bytes":
                        column.append(len(stored))
                    elif x == "media_sha256":
                        column.append(hashlib.sha256(stored).hexdigest())
                    elif x == "pcm":
                        column.append(stored_pcm)
                    elif x == "pcm_bytes":
                        column.append(len(stored_pcm))
                    elif x == "pcm_sha256":
                        column.append(hashlib.sha256(stored_pcm).hexdigest())
                    else:
                        column.append(features(kind, pcm))
            return [pa.array(columns[x], OUTPUTS[x][1]) for x in outputs]

        return work

    return map_texts(documents(df, id_col, text_col), make, ", ".join(f"{x} {OUTPUTS[x][0]}" for x in outputs))


def decode_media(df: DataFrame, stored_rate: int = STORED_RATE, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, codec, rate, payload, pcm (16-bit little-endian at stored_rate), feature and problem (null where the media could be read)."""
    rows_in = df.select(df[id_col].alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    schema = with_id(rows_in, "codec string, rate int, payload binary, pcm binary, feature string, problem string")

    def run(batches):
        for part in slices(batches, "media"):
            rows, good = [], []
            for media in part.column("media").to_pylist():
                try:
                    codec, rate, data = parse(media or b"")
                    rows.append([codec, rate, payload_of(codec, data), None, None, None])
                    good.append((rows[-1], codec, rate, data))
                except ValueError as e:
                    rows.append([None, None, None, None, None, "no media" if media is None else str(e)])
            for (row, codec, rate, _), sound in zip(good, decode_many([(c, d) for _, c, _, d in good]), strict=True):
                pcm = resample(sound, rate, stored_rate)
                row[3:5] = pcm.astype("<i2").tobytes(), features(codec, pcm)
            types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", "codec", "rate", "payload", "pcm", "feature", "problem"])

    return rows_in.mapInArrow(run, schema)
