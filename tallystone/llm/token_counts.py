"""Operator 5: token counts by heap-and-linked-list byte-pair merging.

A chunk's count is its initial symbols minus its merges, which are counted as they are made; no identifiers are emitted. A character that the vocabulary lacks
begins as one symbol for each of its UTF-8 bytes, none of which ever merges. Chunks are cut only where no piece of the vocabulary can span, so counts add up over whole texts; each worker
keeps a bounded memo of chunks.

Rows: one for each input row, repeated rows and null ids included. A null or empty text has 0 tokens. Other columns are not read.
An empty table gives an empty result. A text of any length is counted whole; a chunk of n characters takes O(n log n).
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import Memo, documents, map_texts
from tallystone.llm.normalise import Normaliser
from tallystone.llm.pieces import PieceModel, piece_model


class TokenCounter:
    def __init__(self, model: PieceModel):
        self.model = model
        self.normalise = Normaliser(model.spec)
        self.memo = Memo(self.count_chunk, 400_000)

    def count_chunk(self, chunk: str) -> int:
        known = self.model.ids
        initial = sum(1 if c in known else len(c.encode()) for c in chunk)
        return initial if len(chunk) == 1 else initial - self.model.merge(chunk)[2]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, self.model.chunks(self.normalise(text.encode())[0].decode())))


@lru_cache(2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(piece_model(path))


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes long (UTF-8), n_tokens long, over_limit boolean (n_tokens > limit)."""

    def make():
        counter = token_counter(model_path)
        return lambda texts: [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(counter, texts), pa.int64())]

    counts = map_texts(documents(df, id_col, text_col), make, "n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
