"""A linear classifier: population-standardised features, balanced class weights, ridge penalty; its calibrated form; walk-forward risk; importance of features.

Fits are aggregates over whole tables (fits.py); scoring is column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.models.fits import beside, fit, fit_calibrated, margin, probability, ranked_in_time, standardised
from tallystone.operators.persist import cut


@dataclass
class LinearModel:
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    constant: float
    a: float = 1.0
    b: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.coef + self.constant

    def raw(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))

    def proba(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: a sigmoid of a times the log odds plus b."""
        p = np.clip(self.raw(x), 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-(self.a * np.log(p / (1 - p)) + self.b)))

    def contributions(self, x: np.ndarray) -> dict[str, float]:
        return dict(zip(self.names, (self.coef * (x - self.mean) / self.scale).tolist(), strict=True))

    def importance(self) -> dict[str, float]:
        return dict(zip(self.names, self.coef.tolist(), strict=True))

    def column(self) -> Column:
        """The calibrated probability as an expression over columns of the features' names; null where a feature is."""
        margin = F.lit(self.constant)
        for n, m, s, c in zip(self.names, self.mean, self.scale, self.coef, strict=True):
            margin = margin + (F.col(n) - float(m)) / float(s) * float(c)
        p = F.least(F.greatest(1 / (1 + F.exp(-margin)), F.lit(1e-9)), F.lit(1 - 1e-9))
        return 1 / (1 + F.exp(-(F.log(p / (1 - p)) * float(self.a) + float(self.b))))


def walk_forward_risk(data: DataFrame, features: list[str], first_year: int, horizon: int = 21, least_rows: int = 750) -> DataFrame:
    """(run_id, date, proba, base_rate): each year is forecast by a model of all earlier rows but the last `horizon` before it, whose labels reach into it.

    data: (run_id, date, features, y). All runs and years are fitted together; years without enough rows are left out. A row meets the years after it in the plan alone.
    """
    line = Window.partitionBy("run_id").orderBy("date")
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features])
    rows = data.select("run_id", "date", "y", *[F.col(f).cast("double").alias(f) for f in features]).withColumns({"pos": F.row_number().over(line) - 1, "known": known, "year": F.year("date")})
    use = F.col("known") & F.col("y").isNotNull()
    rows = cut(rows.withColumn("rank", F.when(use, F.count(F.when(use, F.lit(1))).over(line) - 1)))
    years = rows.where(F.col("year") >= first_year).groupBy("run_id", "year").agg(F.min("pos").alias("first")).withColumnRenamed("year", "forecast")
    past = rows.where(use).join(years, "run_id").where(F.col("pos") < F.col("first") - horizon)
    keys = ["run_id", "forecast"]
    fitted = fit_calibrated(past.select(*keys, "rank", "y", *features), keys, features, "rank", least_rows=least_rows)
    models = fitted.table(past.select(*keys)).withColumn("base_rate", F.col("_ones") / F.col("_count"))
    asked = rows.where("known").withColumnRenamed("year", "forecast")
    return beside(asked.select(*keys, "date", *features), models, keys, len(fitted.names)).select("run_id", "date", probability(features).alias("proba"), "base_rate")


def fitted(data: DataFrame, features: list[str], label: str = "y", order: str = "t0", weight: str | None = None, least_rows: int = 40) -> LinearModel | None:
    """A calibrated model of a whole training set, in time by `order`, then by features; rows that lack one or a label go. None with fewer rows or one class."""
    rows = data.select(order, F.col(label).alias("y"), *features, *([weight] if weight else [])).na.drop().withColumn("model", F.lit(0))
    rows = cut(ranked_in_time(cut(rows), order, features))  # counts and ranks must see the same rows
    found = fit_calibrated(rows, ["model"], features, "rank", "y", weight, least_rows)
    if not found.names:
        return None
    return LinearModel(features, found.mean[0], found.scale[0], found.coef[0], float(found.constant[0]), float(found.a[0]), float(found.b[0]))


#: Hex digits of a hash by which a fold's rows are dealt before they are ranked.
DEALT = 3


def permutation_importance(data: DataFrame, features: list[str], folds: DataFrame, seed: int = 42) -> DataFrame:
    """(feature, mean_drop, std_drop) of accuracy over purged folds when a feature is shuffled.

    data: (key, t0, features, y); folds: (key, fold, t0, role). A fold's test rows are ranked twice by MD5 hashes of seed, fold, feature and row; who has a rank by the first gets the
    value that has it by the second. Ranks are taken inside buckets of the hash, so that a fold is no task; a shuffled margin is the row's own but for that feature's share.
    """
    joined = cut(folds.join(data, ["key", "t0"]).select("key", "fold", "t0", "role", "y", *[F.col(f).cast("double").alias(f) for f in features]))
    models = fit(joined.where("role = 'train'"), ["fold"], features)
    test = beside(joined.where("role = 'test'"), models.table(joined.select("fold")), ["fold"], len(models.names))
    own = [x * F.col("_coef")[i] for i, x in enumerate(standardised(features))]
    test = cut(test.select("key", "fold", "t0", (F.col("y") == 1).alias("y"), F.array(*own).alias("own"), margin(features).alias("z")))
    right = lambda z: F.avg(((z >= 0) == F.col("y")).cast("double"))
    base = test.groupBy("fold").agg(right(F.col("z")).alias("base"))
    each = test.select("fold", "key", "t0", "y", "z", F.posexplode("own").alias("i", "share")).withColumn("feature", F.element_at(F.array(*map(F.lit, features)), F.col("i") + 1))
    sides = {}
    for side, columns in (("to", ["y", (F.col("z") - F.col("share")).alias("rest")]), ("from", [F.col("share").alias("new")])):
        name = F.concat_ws(":", F.lit(str(seed)), "fold", "feature", F.lit(side), "key", F.date_format("t0", "yyyy-MM-dd"))
        hashed = each.withColumn("hash", F.md5(name)).withColumn("bucket", F.substring("hash", 1, DEALT))
        sizes = hashed.groupBy("fold", "feature", "bucket").agg(F.count("*").alias("n"))
        line = Window.partitionBy("fold", "feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** DEALT rows
        sizes = sizes.select("fold", "feature", "bucket", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
        here = F.row_number().over(Window.partitionBy("fold", "feature", "bucket").orderBy("hash", "key", "t0"))
        sides[side] = hashed.withColumn("here", here).join(sizes, ["fold", "feature", "bucket"]).select("fold", "feature", (F.col("before") + F.col("here")).alias("rank"), *columns)
    shuffled = sides["to"].join(sides["from"], ["fold", "feature", "rank"]).groupBy("fold", "feature").agg(right(F.col("rest") + F.col("new")).alias("score"))
    drops = shuffled.join(base, "fold").withColumn("drop", F.col("base") - F.col("score"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"))


def top_contributions(names: list[str], coef: list[float], mean: list[float], scale: list[float], n: int = 3) -> Column:
    """The n largest contributions by size, as an array of (size, name, value), over feature columns."""
    parts = [(F.col(f) - m) / s * c for f, c, m, s in zip(names, coef, mean, scale, strict=True)]
    packed = F.array(*[F.struct(F.abs(p).alias("size"), F.lit(f).alias("name"), p.alias("value")) for f, p in zip(names, parts, strict=True)])
    return F.slice(F.reverse(F.array_sort(packed)), 1, n)
