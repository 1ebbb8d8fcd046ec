"""Functions over a sliding window as functions over blocks: a security's bars are dealt in blocks, each with the bars before it that its first windows reach back to, so that a task
holds one block and a long series is spread."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bars of a block, besides those that it reaches back to.
BARS = 4096


def over_blocks(df: DataFrame, column: str, reach: int, work: Callable[[np.ndarray], list[np.ndarray]], names: list[str], key: str = "secid", order: str = "date") -> DataFrame:
    """(key, order, names): work gets the values of up to `reach` bars before a block and of the block, in order, NaN where unknown, and gives as many values of each name; NaN
    becomes null."""
    size = max(BARS, reach)
    rows = df.select(key, order, F.col(column).cast("double").alias("_v"), (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).alias("_i"))
    own = F.floor(F.col("_i") / size)
    ahead = F.when(F.col("_i") % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_own", own).withColumn("_block", F.explode(ahead))
    schema = StructType([df.schema[key], df.schema[order], *(StructField(n, DoubleType()) for n in names)])

    def finished(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks()
        values = block.column("_v").to_numpy(zero_copy_only=False).astype(float)
        mine = pa.array(block.column("_own").to_numpy() == block.column("_block").to_numpy())
        found = [pa.array(x, pa.float64(), from_pandas=True) for x in work(values)]
        out = pa.table([block.column(key), block.column(order), *found], [key, order, *names]).filter(mine).combine_chunks().to_batches()
        return out[0] if out else pa.RecordBatch.from_pylist([], pa.schema([(key, block.schema.field(key).type), (order, block.schema.field(order).type), *((n, pa.float64()) for n in names)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            begin, places = 0, list(zip(batch.column(key).to_pylist(), batch.column("_block").to_pylist(), strict=True))
            for at in [i for i in range(len(places)) if places[i] != (places[i - 1] if i else now)]:
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                if held:
                    yield finished(held)
                held, begin = [], at
            if places:
                held.append(batch.slice(begin))
                now = places[-1]
        if held:
            yield finished(held)

    return dealt.repartition(key, "_block").sortWithinPartitions(key, "_block", "_i").mapInArrow(run, schema)


def sliding_median(values: np.ndarray, n: int) -> np.ndarray:
    """Of the last n values; NaN until there are n known ones. One sorted list takes a value in and lets one go at each step."""
    out, line = np.full(len(values), np.nan), []
    for i, v in enumerate(values):
        if i >= n and not math.isnan(values[i - n]):
            del line[bisect_left(line, values[i - n])]
        if not math.isnan(v):
            insort(line, v)
        if len(line) == n:
            out[i] = (line[(n - 1) // 2] + line[n // 2]) / 2
    return out


def rolling_medians(df: DataFrame, column: str, n: int, out: str, key: str = "secid", order: str = "date") -> DataFrame:
    """(key, order, out): the median of the last n values, null unless all are known."""
    return over_blocks(df, column, n - 1, lambda v: [sliding_median(v, n)], [out], key, order)


def weighted_sums(values: np.ndarray, weights: list[float]) -> np.ndarray:
    """The last values times the weights, the first being the last value's; NaN while there are too few, or one is unknown."""
    n, out = len(weights), np.full(len(values), np.nan)
    if len(values) >= n:
        unknown = np.isnan(values)
        out[n - 1 :] = np.convolve(np.where(unknown, 0.0, values), weights, "valid")
        out[n - 1 :][np.convolve(unknown.astype(float), np.ones(n), "valid") > 0.5] = np.nan
    return out


def fractional_differences(df: DataFrame, column: str, weights: dict[str, list[float]], key: str = "secid", order: str = "date") -> DataFrame:
    """(key, order, names of weights): a difference for each list of weights, all from one pass."""
    reach = max(map(len, weights.values())) - 1
    return over_blocks(df, column, reach, lambda v: [weighted_sums(v, w) for w in weights.values()], list(weights), key, order)
