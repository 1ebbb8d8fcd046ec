"""Validation that respects time: purged folds and the probability of backtest overfitting. Practices that leak are refused."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ForbiddenPracticeError(Exception):
    """A practice that mixes the future into the past."""


def forbid_shuffle(shuffle: bool) -> None:
    if shuffle:
        raise ForbiddenPracticeError("shuffling a time series leaks the future into the past")


def forbid_plain_kfold(*_: object) -> None:
    raise ForbiddenPracticeError("k-fold without purging and embargo overstates quality: use purged_folds")


def folds(df: DataFrame, k: int, order: str, key: str) -> DataFrame:
    """fold from 0: equal splits in order; the first n mod k have one row more."""
    return df.withColumn("fold", F.ntile(k).over(Window.partitionBy(key).orderBy(order)) - 1)


def purged_folds(labels: DataFrame, k: int = 5, embargo: float = 0.01, key: str = "secid") -> DataFrame:
    """(key, fold, t0, role): the test rows of each fold, and the train rows whose label ended before the fold began or which began, embargo
    rows later, after its last label ended. Labels are (key, t0, t1), in time order.

    One sweep over a key's starts and its folds' last ends finds where each fold's right side begins; a key's bounds are one array beside its rows, and a row makes only
    the roles that it has.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    w = Window.partitionBy(key)
    rows = folds(labels.select(key, "t0", "t1"), k, "t0", key).withColumns({"pos": F.row_number().over(w.orderBy("t0")) - 1, "n": F.count("*").over(w)})
    spans = rows.groupBy(key, "fold").agg(F.min("t0").alias("from"), F.max("t1").alias("to"), F.max("n").alias("n"))
    sweep = rows.select(key, F.col("t0").alias("at"), F.lit(0).alias("kind")).unionByName(spans.select(key, F.col("to").alias("at"), F.lit(1).alias("kind"), "fold", "from", "n"), allowMissingColumns=True)
    begun = F.count_if(F.col("kind") == 0).over(w.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = sweep.withColumn("begun", begun).where("kind = 1")
    right = (F.col("begun") + F.floor(F.col("n") * embargo)).alias("right")
    bounds = swept.groupBy(key).agg(F.collect_list(F.struct(F.col("fold").cast("int").alias("fold"), "from", right)).alias("bounds"))  # k of them
    role = lambda b: F.when(F.col("fold") == b["fold"], "test").when((F.col("t1") < b["from"]) | (F.col("pos") >= b["right"]), "train")
    roles = F.filter(F.transform("bounds", lambda b: F.struct(b["fold"].alias("fold"), role(b).alias("role"))), lambda r: r["role"].isNotNull())
    return rows.join(bounds, key).select(key, "t0", F.explode(roles).alias("r")).select(key, "r.fold", "t0", "r.role")


def half_of(rank: int, parts: int) -> int:
    """The rank-th choice of half of the parts that leaves the last one out, as bits: by the combinatorial number system."""
    left, mask = parts // 2, 0
    for part in range(parts - 2, -1, -1):
        if left and rank >= math.comb(part, left):
            rank -= math.comb(part, left)
            mask |= 1 << part
            left -= 1
    return mask


#: Splits whose products with the sums are held at once.
SPLITS = 256


def cscv(performance: DataFrame, parts: int = 8) -> DataFrame:
    """(pbo, n_combinations, median_logit) by combinatorially symmetric cross-validation.

    performance: (t, config, value), all configs at all t; configs compare by their ordinal. Rows are summed by part and config first: parts x configs numbers, which don't grow
    with rows, go to all tasks. Splits are numbered; a task makes its own from their numbers, and multiplies them with the sums in blocks. A split and its
    opposite are one product.
    """
    if parts % 2:
        raise ValueError("an even number of parts is needed")
    times = performance.select("t").distinct().withColumn("part", F.ntile(parts).over(Window.partitionBy(F.lit(0)).orderBy("t")) - 1)
    found = performance.join(times, "t").groupBy("part", "config").agg(F.sum("value").alias("s"), F.count("value").alias("n")).collect()  # parts x configs rows
    spark, configs = performance.sparkSession, sorted({r["config"] for r in found})
    sums, counts = np.zeros((parts, len(configs))), np.zeros((parts, len(configs)))
    place = {c: i for i, c in enumerate(configs)}
    for r in found:
        sums[r["part"], place[r["config"]]], counts[r["part"], place[r["config"]]] = r["s"] or 0.0, r["n"]
    held = spark.sparkContext.broadcast((sums, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = held.value
        for batch in batches:
            ranks = batch.column(0).to_pylist()
            for at in range(0, len(ranks), SPLITS):
                masks = [half_of(r, parts) for r in ranks[at : at + SPLITS]]
                chosen = np.array([[m >> p & 1 for p in range(parts)] for m in masks], float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    one, two = (chosen @ sums) / (chosen @ counts), ((1 - chosen) @ sums) / ((1 - chosen) @ counts)
                logits = []
                for inside, outside in ((one, two), (two, one)):
                    best = np.nan_to_num(inside, nan=-np.inf).argmax(1)  # the first config of those that are best
                    share = (outside < outside[np.arange(len(best)), best][:, None]).sum(1) / max(len(configs) - 1, 1)
                    share = np.clip(share, 1e-6, 1 - 1e-6)
                    logits.append(np.log(share / (1 - share)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(logits))], ["logit"])

    splits = spark.range(math.comb(parts, parts // 2) // 2) if configs else spark.range(0)
    logits = splits.mapInArrow(run, "logit double")
    return logits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_combinations"), F.percentile("logit", 0.5).alias("median_logit"))
