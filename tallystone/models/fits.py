"""Weighted logistic fits of many models at once: every Newton step is one aggregate of gradient and Hessian sums over all rows, by model.

A row may belong to many models (a year's forecast learns from all years before it): callers join or explode rows to models in the plan, which needs no shuffle, as sums are
taken where the rows are. The driver gets the sums of each model, k + 1 and half its square numbers, and solves for the step; a step that raises the loss is halved.
Coefficients go back as a small table beside the rows. Memory doesn't grow with rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Models whose coefficients are broadcast; more are joined by a shuffle of neither rows nor sums but of the coefficients' keys.
MOST_BROADCAST = 50_000
#: Rounds at most, and the step below which a model has converged.
ROUNDS, CLOSE = 100, 1e-9


@dataclass
class Fitted:
    """keys: of each model; the arrays have a row for each of them."""

    keys: list[str]
    names: list[tuple]
    n: np.ndarray
    ones: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    constant: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def table(self, like: DataFrame) -> DataFrame:
        """A row for each model: its keys and its numbers, under names that no feature has."""
        schema = StructType([*(like.schema[k] for k in self.keys), *StructType.fromDDL("_count long, _ones long, _mean array<double>, _scale array<double>, _coef array<double>, _constant double, _slope double, _level double").fields])
        rows = [(*k, *(x.tolist() for x in row)) for k, *row in zip(self.names, self.n, self.ones, self.mean, self.scale, self.coef, self.constant, self.a, self.b, strict=True)]
        return like.sparkSession.createDataFrame(rows, schema)


def beside(rows: DataFrame, table: DataFrame, keys: list[str], models: int) -> DataFrame:
    """rows with their model's numbers; rows of other models go."""
    return rows.join(F.broadcast(table) if models <= MOST_BROADCAST else table, keys)


def dot(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def newton(rows: DataFrame, keys: list[str], x: list[Column], y: Column, weight: Column, names: list[tuple], penalty: float, offset: Column | None = None) -> np.ndarray:
    """For each model of `names` the coefficients of x and, last, an unpenalised constant that minimise weighted log loss plus penalty / 2 times squared coefficients. x, y, weight and
    offset (a fixed part of the margin) are expressions over rows."""
    k, spark = len(x), rows.sparkSession
    columns = [*x, F.lit(1.0)]
    rows = rows.select(*keys, y.cast("double").alias("_y"), weight.alias("_w"), (F.lit(0.0) if offset is None else offset).alias("_o"), *[c.alias(f"_x{i}") for i, c in enumerate(columns)])
    schema = StructType([*(rows.schema[c] for c in keys), *StructType.fromDDL("_b array<double>").fields])
    ridge = np.r_[np.full(k, penalty), 1e-12]
    place = {name: i for i, name in enumerate(names)}
    found, trial, step = (np.zeros((len(names), k + 1)) for _ in range(3))
    loss, size, going = np.full(len(names), np.inf), np.ones(len(names)), np.ones(len(names), bool)
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    for _ in range(ROUNDS):
        if not going.any():
            break
        table = spark.createDataFrame([(*name, trial[i].tolist()) for name, i in place.items() if going[i]], schema)
        z = dot([F.col("_o"), *[F.col("_b")[i] * F.col(f"_x{i}") for i in range(k + 1)]])
        with_z = beside(rows, table, keys, len(names)).withColumn("_z", z)
        with_p = with_z.withColumn("_p", 1 / (1 + F.exp(-F.greatest(F.least("_z", F.lit(500.0)), F.lit(-500.0)))))
        rest, curve = F.col("_w") * (F.col("_p") - F.col("_y")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        with_p = with_p.withColumns({"_r": rest, "_c": curve})
        cost = F.col("_w") * (F.log1p(F.exp(-F.abs("_z"))) + F.greatest("_z", F.lit(0.0)) - F.col("_y") * F.col("_z"))
        sums = [F.sum(F.col("_r") * F.col(f"_x{i}")) for i in range(k + 1)] + [F.sum(F.col("_c") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs]
        for r in with_p.groupBy(*keys).agg(F.sum(cost).alias("_cost"), F.array(*sums).alias("_sums")).collect():  # a row for each model
            i, values = place[tuple(r[c] for c in keys)], np.array(r["_sums"])
            now = r["_cost"] + 0.5 * float(ridge @ trial[i] ** 2)
            if now > loss[i] + 1e-12 * abs(loss[i]) and size[i] > 1e-6:
                size[i] /= 2
                trial[i] = found[i] - size[i] * step[i]
                continue
            found[i], loss[i], size[i] = trial[i], now, 1.0
            hessian = np.zeros((k + 1, k + 1))
            for (a, b), value in zip(pairs, values[k + 1 :], strict=True):
                hessian[a, b] = hessian[b, a] = value
            step[i] = np.linalg.solve(hessian + np.diag(ridge + 1e-12), values[: k + 1] + ridge * found[i])
            trial[i] = found[i] - step[i]
            if np.abs(step[i]).max() < CLOSE:
                found[i], going[i] = trial[i], False
    return found


def standardised(features: list[str]) -> list[Column]:
    return [(F.col(f) - F.col("_mean")[i]) / F.col("_scale")[i] for i, f in enumerate(features)]


def fit(rows: DataFrame, keys: list[str], features: list[str], label: str = "y", weight: str | None = None, c: float = 1.0) -> Fitted:
    """A model for each key: population-standardised features, balanced class weights times the rows' own, ridge penalty. Models that see one class alone are left out."""
    moments = [f(x) for x in features for f in (F.avg, F.stddev_pop)]
    seen = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("ones"), F.array(*moments).alias("moments")).collect()  # a row for each model
    seen = sorted((r for r in seen if 0 < r["ones"] < r["n"]), key=str)
    names, k = [tuple(r[x] for x in keys) for r in seen], len(features)
    n, ones = np.array([r["n"] for r in seen], "i8"), np.array([r["ones"] for r in seen], "i8")
    moments = np.array([r["moments"] for r in seen]).reshape(-1, k, 2)
    mean, scale = moments[:, :, 0], np.where(moments[:, :, 1] > 0, moments[:, :, 1], 1.0)
    out = Fitted(keys, names, n, ones, mean, scale, np.zeros((len(n), k)), *(np.full(len(n), v) for v in (0.0, 1.0, 0.0)))
    if names:
        joined = beside(rows, out.table(rows).select(*keys, "_count", "_ones", "_mean", "_scale"), keys, len(names))
        own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        y = F.col(label)
        balance = F.when(y == 1, F.col("_count") / (2 * F.col("_ones"))).otherwise(F.col("_count") / (2 * (F.col("_count") - F.col("_ones"))))
        found = newton(joined, keys, standardised(features), y, balance * own, names, 1 / c)
        out.coef, out.constant = found[:, :-1], found[:, -1]
    return out


def margin(features: list[str]) -> Column:
    """Over rows that stand beside their model's table."""
    return dot([F.col("_constant"), *[x * F.col("_coef")[i] for i, x in enumerate(standardised(features))]])


def log_odds(features: list[str]) -> Column:
    """Of the raw probability, kept off 0 and 1."""
    p = F.least(F.greatest(1 / (1 + F.exp(-margin(features))), F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def probability(features: list[str]) -> Column:
    """Calibrated, over rows that stand beside their model's table."""
    return 1 / (1 + F.exp(-(F.col("_slope") * log_odds(features) + F.col("_level"))))


def fit_calibrated(rows: DataFrame, keys: list[str], features: list[str], rank: str, label: str = "y", weight: str | None = None, least_rows: int = 1) -> Fitted:
    """As `fit`, of the first four fifths in time; the rest calibrates: a sigmoid of a times the log odds plus b. Too few rows or one class on either side leave the raw scores
    of a model of all rows. rank: a row's place in time within its model, from 0. n and ones count all rows.

    A falling calibration would turn the ranking round; then only the level is moved, so that the mean probability is the share of ones.
    """
    counts = {tuple(r[x] for x in keys): r for r in rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("ones")).collect()}  # a row for each model
    counts = {k: r for k, r in counts.items() if r["n"] >= least_rows and 0 < r["ones"] < r["n"]}
    if not counts:
        return fit(rows.where("false"), keys, features, label, weight)
    schema = StructType([*(rows.schema[c] for c in keys), *StructType.fromDDL("_cut long, _n long").fields])
    cuts = lambda cut: rows.sparkSession.createDataFrame([(*k, cut[k], r["n"]) for k, r in counts.items()], schema)
    cut = {k: min(max(int(0.8 * r["n"]), 10), r["n"]) for k, r in counts.items()}
    placed = beside(rows, cuts(cut), keys, len(cut))
    early = F.col(rank) < F.col("_cut")
    for r in placed.groupBy(*keys).agg(F.sum(F.when(early, F.col(label)).otherwise(0).cast("long")).alias("first"), F.sum(F.when(~early, F.col(label)).otherwise(0).cast("long")).alias("late")).collect():
        k = tuple(r[x] for x in keys)
        n = counts[k]["n"]
        if not (0 < r["first"] < cut[k] and 0 < r["late"] < n - cut[k]):
            cut[k] = n
    placed = beside(rows, cuts(cut), keys, len(cut))
    out = fit(placed.where(early), keys, features, label, weight)
    late = beside(placed.where(~early), out.table(rows).drop("_count", "_ones"), keys, len(cut)).withColumn("_odds", log_odds(features))
    held = [i for i, k in enumerate(out.names) if cut[k] < counts[k]["n"]]
    if held:
        names = [out.names[i] for i in held]
        found = newton(late, keys, [F.col("_odds")], F.col(label), F.lit(1.0), names, 1e-6)
        out.a[held], out.b[held] = found[:, 0], found[:, 1]
        falling = [i for i in held if out.a[i] <= 0]
        if falling:
            level = newton(late, keys, [], F.col(label), F.lit(1.0), [out.names[i] for i in falling], 0.0, F.col("_odds"))
            out.a[falling], out.b[falling] = 1.0, level[:, 0]
    out.n, out.ones = (np.array([counts[k][c] for k in out.names], "i8") for c in ("n", "ones"))
    return out


def ranked_in_time(data: DataFrame, time: str, ties: list[str], out: str = "rank") -> DataFrame:
    """data with each row's place in time, from 0; equal times are settled by `ties`. A time's rows are one window; what comes before it is counted by time."""
    line = Window.partitionBy(F.lit(0)).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)  # a row for each time
    before = data.groupBy(time).agg(F.count("*").alias("_n")).select(time, F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(time).orderBy(*ties)) - 1
    return data.withColumn("_here", here).join(before, time).withColumn(out, F.col("_before") + F.col("_here")).drop("_before", "_here")
