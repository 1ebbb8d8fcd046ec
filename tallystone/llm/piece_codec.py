"""Operator 9: offset-preserving sentencepiece encoding and decoding.

Normalisation takes the longest prefix of the text that the compiled character map holds and records where each byte came from; the pieces
that merging then leaves are projected to byte spans of the source. Decoding maps ids to surfaces by a table; the bytes of fallback pieces
are joined before they are read as UTF-8.

Rows: one for each input row, repeated rows and null ids included. A null or empty text has no piece but the end id, if asked for, and
decodes to the empty text. Other columns are not read; an empty table gives an empty result. Whole texts are encoded, however long.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import Memo, documents, map_texts, with_id
from tallystone.llm.normalise import Normaliser
from tallystone.llm.pieces import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, piece_model

#: What an operator can return for each text.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "begins": ("array<int>", pa.list_(pa.int32())),
    "ends": ("array<int>", pa.list_(pa.int32())),
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "spanned_bytes": ("long", pa.int64()),
}


class PieceCodec:
    def __init__(self, path: str):
        self.model = m = piece_model(path)
        self.normalise = Normaliser(m.spec)
        self.memo = Memo(self._chunk, 400_000)
        surface = []
        for piece, kind in zip(m.pieces, m.kinds, strict=True):
            surface.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
        self.unknown = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), -1)
        if self.unknown >= 0:
            surface[self.unknown] = " ⁇ ".encode()
        self.surface = surface
        self.bytes_of = np.array([1 if k == BYTE else len(p.encode()) if k == NORMAL else 0 for p, k in zip(m.pieces, m.kinds, strict=True)], "i8")
        self.decimal = [str(i).encode() for i in range(len(m.pieces))]
        self.controls = {i for i, k in enumerate(m.kinds) if k == CONTROL}
        self.is_byte = [k == BYTE for k in m.kinds]

    def _chunk(self, chunk: str) -> bytes:
        m = self.model
        symbols, after, _ = m.merge(chunk)
        ids, at = [], 0
        while at < len(chunk):
            if symbols[at] >= 0:
                ids.append(symbols[at])
            else:
                ids += [m.byte_ids[b] for b in chunk[at].encode()]
            at = after[at]
        return np.array(ids, "i4").tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids, and the ends of their spans in bytes of the source; a span begins where the one before it ends."""
        normal, source = self.normalise(text.encode())
        ids = np.frombuffer(b"".join(map(self.memo.__getitem__, self.model.chunks(normal.decode()))), "i4")
        return ids, source[np.cumsum(self.bytes_of[ids])]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): the space that the dummy prefix made goes; bytes that are not UTF-8 give U+FFFD each."""
        parts = list(map(self.surface.__getitem__, ids))
        if self.normalise.prefix or self.normalise.squeeze:
            for i, k in enumerate(ids):
                if self.model.kinds[k] != CONTROL:
                    if self.model.kinds[k] == NORMAL and parts[i][:1] == b" ":
                        parts[i] = parts[i][1:] if not self.normalise.squeeze else parts[i].lstrip(b" ")
                    break
        if self.controls.isdisjoint(ids[:-1]):  # a control piece inside ends a run of byte pieces
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self._decode_bytes(ids, parts)

    def _decode_bytes(self, ids: list[int], parts: list[bytes]) -> str:
        out, run = [], bytearray()
        for k, part in [*zip(ids, parts, strict=True), (-1, b"")]:
            if k >= 0 and self.is_byte[k]:
                run += part
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run = bytearray()
            out.append(part.decode())
        return "".join(out)


@lru_cache(2)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_texts(
    df: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids", "begins", "ends"), add_eos: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and the named OUTPUTS. ids: with the end id last if add_eos. begins, ends: byte spans of the pieces in the UTF-8 source, the end
    id's being empty. decoded: what decode gives for ids. spanned_bytes: bytes of the source that the spans cover."""

    def make():
        codec = piece_codec(model_path)

        def work(texts: list[str]) -> list[pa.Array]:
            columns: dict[str, list] = {x: [] for x in outputs}
            for text in texts:
                ids, ends = codec.encode(text)
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                if add_eos:
                    last = ends[-1:] if len(ends) else np.zeros(1, "i8")
                    ids, begins, ends = np.append(ids, np.int32(codec.model.eos)), np.append(begins, last), np.append(ends, last)
                listed = ids.tolist()
                decoded = codec.decode(listed) if {"decoded", "decoded_sha256"} & {*outputs} else ""
                for x, column in columns.items():
                    if x in ("ids", "begins", "ends"):
                        column.append({"ids": ids, "begins": begins, "ends": ends}[x].astype("i4"))
                    elif x == "n_tokens":
                        column.append(len(listed))
                    elif x == "ids_sha256":
                        column.append(hashlib.sha256(b" ".join(map(codec.decimal.__getitem__, listed))).hexdigest())
                    elif x == "decoded":
                        column.append(decoded)
                    elif x == "decoded_sha256":
                        column.append(hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        column.append(int((ends - begins).sum()))
            return [pa.array(columns[x], OUTPUTS[x][1]) for x in outputs]

        return work

    return map_texts(documents(df, id_col, text_col), make, ", ".join(f"{x} {OUTPUTS[x][0]}" for x in outputs))


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text, decoded from a column of id arrays; a null array gives the empty text, a null id inside it is passed over."""
    rows = df.select(df[id_col].alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        codec = piece_codec(model_path)
        for batch in batches:
            texts = [codec.decode([i for i in ids or () if i is not None]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, with_id(rows, "text string"))
