"""Drift monitors: population stability, two-sample distances, CUSUM events, and ranking quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallystone.operators.persist import cut

STRONG_DRIFT = 0.25
EPS = 1e-6


#: Ranges that a feature's values are dealt into, about equally many each, so that running totals need no task for a whole feature; a power of two, for the search.
RANGES = 1024


def ranged(rows: DataFrame, key: str, value: str, *totals: Column) -> DataFrame:
    """rows with `_b`, the range of their value among those of their key: a quantile sketch of each key's values chooses the cuts. Totals of the key stand beside it."""
    shares = [i / RANGES for i in range(1, RANGES)]
    cuts = rows.groupBy(key).agg(F.percentile_approx(value, shares, 4 * RANGES).alias("_cuts"), *totals)
    halves = F.array(*[F.lit(RANGES >> i) for i in range(1, RANGES.bit_length())])
    # how many cuts are at or below the value, by halving
    at = F.aggregate(halves, F.lit(0), lambda s, k: F.when(F.element_at("_cuts", s + k) <= F.col(value), s + k).otherwise(s))
    return rows.join(cuts, key).withColumn("_b", at).drop("_cuts")


def running(counts: DataFrame, key: str, value: str, columns: list[str]) -> DataFrame:
    """counts (key, value, columns; a row for each value) with `before_<column>`: the sum over the key's smaller values, and `all_<column>`: over all of them."""
    placed = ranged(counts, key, value, *[F.sum(c).alias(f"all_{c}") for c in columns])
    sums = placed.groupBy(key, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    line = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    carried = sums.select(key, "_b", *[F.coalesce(F.sum(f"_{c}").over(line), F.lit(0)).alias(f"_carried_{c}") for c in columns])
    inner = Window.partitionBy(key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(carried, [key, "_b"])
    before = [(F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"_carried_{c}")).alias(f"before_{c}") for c in columns]
    return out.select(*counts.columns, *[f"all_{c}" for c in columns], *before)


def _counted(samples: DataFrame) -> DataFrame:
    """A row for each finite value of a feature, written once: the ranges, their totals and the samples' counts all read it."""
    known = samples.where(F.abs("value") < float("inf"))  # neither null nor NaN
    counts = known.groupBy("feature", "value").agg(F.count_if(~F.col("live")).alias("e"), F.count_if("live").alias("a"))
    return cut(counts)


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(feature, q: array, lo, hi, n) of counts (feature, value, e): linear interpolation between the values at the two nearest ranks."""
    ranked = running(counts.where("e > 0").select("feature", "value", "e"), "feature", "value", ["e"])
    rank = lambda p: F.lit(p) * (F.col("all_e") - 1)
    wanted = F.array(*[f(rank(p)).cast("long") for p in shares for f in (F.floor, F.ceil)])
    hits = ranked.withColumn("_at", F.filter(wanted, lambda x: (x >= F.col("before_e")) & (x < F.col("before_e") + F.col("e"))))
    # of each feature a few rows are left
    held = hits.where(F.size("_at") > 0).select("feature", "value", "all_e", F.explode(F.array_distinct("_at")).alias("_rank"))
    at = held.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_value"), F.max("all_e").alias("n"))
    edge = counts.where("e > 0").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))

    def between(p: float):
        r = F.lit(p) * (F.col("n") - 1)
        low, high = F.col("_value")[F.floor(r).cast("long")], F.col("_value")[F.ceil(r).cast("long")]
        return low + (high - low) * (r - F.floor(r))

    return at.select("feature", F.array(*[between(p) for p in shares]).alias("q"), "n").join(edge, "feature")


def psi(samples: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, psi, strong) of samples (feature, live boolean, value): bins at the quantiles of the reference sample, equal edges once, ends open."""
    counts = _counted(samples)
    edges = quantiles(counts, [i / bins for i in range(1, bins)])
    inner = F.filter(F.array_distinct("q"), lambda x: (x > F.col("lo")) & (x < F.col("hi")))
    edges = edges.where(F.col("n") >= bins).select("feature", inner.alias("inner"))
    placed = counts.join(edges, "feature").withColumn("bin", F.size(F.filter("inner", lambda x: x <= F.col("value"))))
    binned = placed.groupBy("feature", "bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    w = Window.partitionBy("feature")
    shares = binned.select("feature", (F.col("e") / F.sum("e").over(w) + EPS).alias("e"), (F.col("a") / F.sum("a").over(w) + EPS).alias("a"))
    # bins that both samples leave empty add nothing
    out = shares.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))
    return out.withColumn("strong", F.col("psi") > STRONG_DRIFT)


def worst_first(table: DataFrame, column: str, key: str = "feature") -> DataFrame:
    """A report's table (a row for each feature) with its place by the column, greatest first, unknown ones last."""
    return table.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(column), key))).orderBy("place")


def ks_distance(samples: DataFrame) -> DataFrame:
    """(feature, statistic, n_reference, n_live, p_value): the largest distance of the two samples' distribution functions. Values are counted first, so ties cost nothing."""
    upto = running(_counted(samples), "feature", "value", ["e", "a"])
    gap = F.abs((F.col("before_e") + F.col("e")) / F.col("all_e") - (F.col("before_a") + F.col("a")) / F.col("all_a"))
    out = upto.withColumn("gap", gap).groupBy("feature").agg(F.max("gap").alias("statistic"), F.max("all_e").alias("n_reference"), F.max("all_a").alias("n_live"))
    return out.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_reference"), F.col("n_live")))


def ks_p_value(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of a two-sample distance (Kolmogorov's series)."""
    x = statistic * F.sqrt(n * m / (n + m))
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + sign(k) * F.exp(-2 * k * k * x * x))
    return F.when(x < 1e-3, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def cusum(series: DataFrame, threshold: float, key: str = "secid", order: str = "date", column: str = "close") -> DataFrame:
    """(key, order, direction): times at which the cumulated rise or fall since the last event exceeds the threshold.

    A security's bars pass its task as a sorted stream; its state, the rise, the fall and the last value, is all that is held, however long the series is.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    schema = StructType([series.schema[key], series.schema[order], StructField("direction", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, up, down = object(), 0.0, 0.0, 0.0
        for batch in batches:
            at, directions = [], []
            for i, (k, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if k != now:
                    now, last, up, down = k, v, 0.0, 0.0
                    continue
                step, last = v - last, v
                up, down = max(0.0, up + step), min(0.0, down + step)
                if up > threshold:
                    up = 0.0
                    at.append(i)
                    directions.append(1)
                elif down < -threshold:
                    down = 0.0
                    at.append(i)
                    directions.append(-1)
            found = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), pa.array(directions, pa.int32())], [key, order, "direction"])

    known = series.select(key, order, F.col(column).cast("double").alias("_v")).where("_v is not null")
    return known.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def auc(scored: DataFrame, key: str) -> DataFrame:
    """(key, auc) of (key, y 0/1, score) by average ranks; null if a class is missing. Equal scores are counted first."""
    counts = scored.groupBy(key, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("n"))
    ranks = running(counts, key, "score", ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    sums = ranks.groupBy(key).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(key, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))
