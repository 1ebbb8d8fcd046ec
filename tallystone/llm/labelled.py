"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def doc_crc(doc_id: Column) -> Column:
    """CRC-32 of the id as text; null ids give that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, class_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of whole documents of either class, in the order of a hash of their id, among those where `learn` (over doc_id) holds and the label
    is 0 or 1: at most `per_class`; each is taken if all taken so far and it have at most `class_bytes` bytes, and passed over otherwise.

    A document labelled twice counts as 1 if any label is 1; of texts that share an id, one is taken by a hash of the text. The bounds make what the
    driver gathers the same for any input: first sizes of 2 * per_class documents, then the texts that were chosen.
    """
    documents = documents.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("hash"))  # whatever else the caller's rows hold
    known = labels.where(labels.doc_id.isNotNull() & labels[label].isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.coalesce(1)  # 2 * per_class rows
    found = documents.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("hash", F.octet_length("text").alias("bytes"))).alias("least"))
    taken, left = [], {0: class_bytes, 1: class_bytes}
    for r in found.select("doc_id", "label", "least.*", F.xxhash64("doc_id").alias("order")).orderBy("order", "doc_id").collect():
        if r["bytes"] <= left[r["label"]]:
            left[r["label"]] -= r["bytes"]
            taken.append((r["doc_id"], r["hash"], r["label"]))
    chosen = documents.sparkSession.createDataFrame(taken, StructType([documents.schema["doc_id"], documents.schema["hash"], StructField("label", IntegerType())]))
    texts = documents.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"])))
    return [(r["text"], r["label"]) for r in rows]


def share_of_ones(labels: DataFrame, label: str, learn: Column) -> float:
    """Share of label 1 among all labels that may be used, kept off 0 and 1; 0.5 if there is none."""
    known = labels.where(labels.doc_id.isNotNull() & labels[label].isin(0, 1) & learn)
    share = known.agg(F.avg(label).alias("share")).first()["share"]
    return 0.5 if share is None else min(max(share, 0.01), 0.99)


def logistic(x, y, weight=None, rounds: int = 50, ridge: float = 1e-3):
    """Newton's method for a logistic fit of y on the columns of x and a constant; gives the coefficients, the constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = weight * p * (1 - p)
        h = (x * w[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising fit: neighbours that fall are pooled until none do; between two pools the fit is a line."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([weight[i], weight[i] * x[i], weight[i] * y[i]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    w, wx, wy = np.array(pools).T
    return wx / w, wy / w


@dataclass(frozen=True)
class Calibration:
    """A rising line through knots, of which the score keeps all but a hundredth; that is a logistic curve over their middle, so that it rises where the
    line is level."""

    at: tuple[float, ...]
    value: tuple[float, ...]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Calibration:
        at, value = isotonic(x, y, weight)
        return cls(tuple(map(float, at)), tuple(map(float, value)))

    def curve(self):
        at, value = np.array(self.at), np.array(self.value)
        middle, width = (at[0] + at[-1]) / 2, max(at[-1] - at[0], 1e-9) / 8

        def score(x: float) -> float:
            curve = 1 / (1 + math.exp(-max(-30.0, min(30.0, (x - middle) / width))))
            return 0.99 * float(np.interp(x, at, value)) + 0.01 * curve

        return score
