"""Operator 7: quality by compression.

Two zstandard dictionaries are built, one from blocks of good and one from blocks of bad labelled text. A text is cut into blocks of at most
BLOCK_CHARS characters; the size that its blocks have with the bad dictionary less that with the good one, over its bytes, is its evidence. An
isotonic fit of the label on this one number, over labelled texts that built no dictionary, turns it into a score; its weights restore the share of
label 1 among all labels that may be used, which is counted over all of them.

Learned from at most `per_class` whole documents and `class_bytes` bytes of either label (labelled.sample). Scored: every whole text.

Rows: one for each input row, repeated rows and null ids included. A null or empty text gets the share of label 1. Equal texts have equal scores.
Other columns are not read; an empty table gives an empty result. If either label is missing among what may be learned, every score is the share of
label 1, kept off 0 and 1 by a hundredth, or a half if there is no label at all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import documents as view
from tallystone.llm.common import map_texts
from tallystone.llm.labelled import Calibration, sample, share_of_ones

#: Short, so that a block leans on the dictionary more than on itself.
BLOCK_CHARS = 512
DICTIONARY_BYTES = 112 << 10
LEVEL = 3


def blocks(text: str) -> list[bytes]:
    return [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]


def dictionary(texts: list[str]) -> bytes:
    """Trained on pieces of the texts; if there are too few for that, their own end."""
    import zstandard

    pieces = [t[i : i + 512].encode() for t in texts for i in range(0, len(t), 512)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


class Evidence:
    """Of a text's blocks: size with the bad dictionary less size with the good one, over its bytes."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.sizers = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.sizers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False).compress)

    def __call__(self, text: str) -> float:
        of_good, of_bad = self.sizers
        difference = total = 0
        for b in blocks(text):
            difference += len(of_bad(b)) - len(of_good(b))
            total += len(b)
        return difference / max(total, 1)


@dataclass(frozen=True)
class CompressionModel:
    """share: of label 1, the score where there is nothing to weigh; good, bad: the dictionaries."""

    share: float
    good: bytes = b""
    bad: bytes = b""
    calibration: Calibration | None = None

    def scorer(self):
        if self.calibration is None:
            return lambda text: self.share
        evidence, calibrated = Evidence(self.good, self.bad), self.calibration.curve()
        return lambda text: calibrated(evidence(text)) if text else self.share


def fit_rows(rows: list[tuple[str, int]], share: float) -> CompressionModel:
    """share: of label 1 among all labels that may be used."""
    if len({y for _, y in rows}) < 2:
        return CompressionModel(share)
    built, rest = rows[::2], rows[1::2]
    if len({y for _, y in built}) < 2 or len({y for _, y in rest}) < 2:
        built = rest = rows
    good, bad = dictionary([t for t, y in built if y]), dictionary([t for t, y in built if not y])
    evidence = Evidence(good, bad)
    x, y = np.array([evidence(t) for t, _ in rest]), np.array([y for _, y in rest])
    return CompressionModel(share, good, bad, Calibration.fit(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))))


def fit(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = 1500, class_bytes: int = 8 << 20) -> CompressionModel:
    """learn: which labels may be used, over doc_id."""
    return fit_rows(sample(documents, labels, label, learn, per_class, class_bytes), share_of_ones(labels, label, learn))


def score_texts(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, the text (null: empty) if keep_text, score double (0 to 1, higher: label 1 likelier)."""

    def make():
        score = model.scorer()
        return lambda texts: [pa.array(map(score, texts), pa.float64())]

    return map_texts(view(df, id_col, text_col), make, "score double", keep_text)


def predict(df: DataFrame, model: CompressionModel, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted int (1 if score >= threshold)."""
    return score_texts(df, model, id_col, text_col).withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
